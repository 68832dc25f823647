"""Rolling windows, exact quantiles of long regions, autocorrelation, symbolic windows and random places against plain models."""

import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsetrack.operators import shapes, summaries, windows
from sparsetrack.plans.intervals import sections_of

SCHEMA = "chrom string, start long, end long, value double"


def track(spark, seed, size=400, share=0.5):
    """A sparse signal of runs on two chromosomes, and its bases."""
    rng, rows, bases = random.Random(seed), [], {}
    for chrom in ("a", "b"):
        at = rng.randrange(20)
        while at < size:
            end = min(size, at + rng.randrange(1, 12))
            v = float(rng.randrange(-5, 9))
            rows.append((chrom, at, end, v))
            bases |= {(chrom, p): v for p in range(at, end)}
            at = end + (rng.randrange(1, 25) if rng.random() > share else 0)
    return spark.createDataFrame(rows, SCHEMA), bases


def whole(spark, size=400):
    return sections_of(spark.createDataFrame([("a", size), ("b", size)], "chrom string, size long"))


@pytest.mark.parametrize(("size", "step", "max_na", "fill"), [(1, 1, None, None), (7, 1, None, None), (24, 5, 20, None), (10, 1, 3, 0.0), (150, 1, 149, None), (400, 1, 399, None), (500, 1, 499, None)])
def test_roll(spark, size, step, max_na, fill):
    signal, bases = track(spark, size)
    got = {(r.chrom, r.start, r.end): r.value for r in windows.roll(signal, whole(spark), "mean", size, step, max_na, fill=fill).collect()}
    limit = size // 2 if max_na is None else (size - 1 if max_na > size else max_na)
    want, o = {}, size // 2 - step // 2
    for chrom in "ab":
        for p in range(0, 400 - size + 1, step):
            v = [bases.get((chrom, q), fill) for q in range(p, p + size)]
            v = [x for x in v if x is not None]
            if v and size - len(v) <= limit:
                want[chrom, p + o, p + o + step] = sum(v) / len(v)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_roll_in_sections_of_one_chromosome(spark):
    signal, bases = track(spark, 5)
    sections = spark.createDataFrame([(1, "a", 10, 60), (2, "a", 40, 130), (3, "b", 0, 9)], "section_id long, chrom string, start long, end long")
    got = {(r.section_id, r.start): r.value for r in windows.roll(signal, sections, "total", 8, 3, 7).collect()}
    want = {}
    for i, c, s, e in ((1, "a", 10, 60), (2, "a", 40, 130), (3, "b", 0, 9)):
        for p in range(s, e - 7, 3):
            v = [bases[c, q] for q in range(p, p + 8) if (c, q) in bases]
            if v:
                want[i, p + 3] = sum(v)
    assert got == want


def test_roll_does_not_cancel(spark):
    """A huge value that has left the window leaves nothing behind."""
    rows = [("a", i, i + 1, 1e16 if i % 50 == 0 else 1e-3) for i in range(300)]
    one = sections_of(spark.createDataFrame([("a", 300)], "chrom string, size long"))
    got = [r.value for r in windows.roll(spark.createDataFrame(rows, SCHEMA), one, "mean", 10).where("start % 50 between 10 and 40").collect()]
    assert len(got) > 100 and all(math.isclose(v, 1e-3, rel_tol=1e-9) for v in got)


def test_roll_time_does_not_follow_the_size(spark):
    signal = spark.range(0, 200_000).select(F.lit("a").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), (F.col("id") % 17).cast("double").alias("value"))
    one = sections_of(spark.createDataFrame([("a", 200_000)], "chrom string, size long"))
    took = {}
    for size in (10, 10, 5_000):
        began = time.time()
        windows.roll(signal, one, "mean", size).write.format("noop").mode("overwrite").save()
        took[size] = time.time() - began
    assert took[5_000] < 3 * took[10] + 2


def pick(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo = math.floor(at)
    return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo)


@pytest.mark.parametrize("cuts", [2, 5, 128])
def test_selected_quantiles(spark, cuts):
    rng = random.Random(cuts)
    rows = [(k, rng.choice([float(rng.randrange(6)), rng.gauss(0, 1), 10 ** rng.uniform(-200, 200)]), rng.randrange(1, 9)) for k in range(4) for _ in range((1, 2, 50, 700)[k])]
    rows += [(5, 3.0, 1000)] * 3  # one value
    got = {r.rid: r.q for r in summaries.selected(spark.createDataFrame(rows, "rid long, v double, w long"), ["rid"], summaries.QUANTILES, cuts).collect()}
    for k in {r[0] for r in rows}:
        each = [v for key, v, w in rows if key == k for _ in range(w)]
        assert all(math.isclose(a, pick(each, q), rel_tol=1e-12) for a, q in zip(got[k], summaries.QUANTILES, strict=True))


def test_long_regions_equal_buffered_ones(spark):
    signal, bases = track(spark, 9)
    regions = spark.createDataFrame([("a", 0, 400, 1), ("a", 3, 9, 2), ("b", 50, 300, 3), ("b", 50, 300, 4), ("c", 0, 90, 5)], "chrom string, start long, end long, row_id long")
    for args in ({"quantiles": True}, {"median": True}, {"quantiles": True, "fill": 0.0}):
        plain = sorted(map(str, summaries.summary(signal, regions, **args).collect()))
        assert sorted(map(str, summaries.summary(signal, regions, long=20, **args).collect())) == plain
    tiles = lambda **k: sorted(map(str, summaries.summary(signal, 37, whole(spark), quantiles=True, **k).collect()))
    assert tiles(long=30) == tiles()
    total = summaries.summary(signal, regions, quantiles=True, total=True).first()
    each = [bases[c, p] for c, s, e, _ in regions.collect() for p in range(s, e) if (c, p) in bases]
    assert math.isclose(total.median, statistics.median(each)) and math.isclose(total.q90, pick(each, 0.9)) and total.num_data == len(each)
    nothing = summaries.summary(signal.limit(0), regions, total=True).first()
    assert nothing.num_data == 0 and nothing.median is None


def test_no_buffer_for_long_regions(spark):
    signal = spark.range(0, 30_000).select(F.lit("a").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.xxhash64("id").cast("double").alias("value"))
    regions = spark.createDataFrame([("a", 0, 30_000)], "chrom string, start long, end long")
    out = summaries.summary(signal, regions, long=1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and out.first().median == statistics.median(r.value for r in signal.collect())


def test_autocorrelation(spark):
    signal, bases = track(spark, 3)
    m = statistics.fmean(bases.values())
    for tile in (64, 1 << 16):
        got = {r.lag: r for r in windows.autocorrelation(signal, whole(spark), 399, tile).collect()}
        cov0 = statistics.fmean((v - m) ** 2 for v in bases.values())
        for lag in (0, 1, 2, 30, 63, 64, 65, 200, 399):
            pairs = [(v - m) * (bases[c, p + lag] - m) for (c, p), v in bases.items() if (c, p + lag) in bases]
            assert got[lag].n == len(pairs)
            if pairs:
                assert math.isclose(got[lag].covariance, statistics.fmean(pairs), abs_tol=1e-9) and math.isclose(got[lag].correlation, statistics.fmean(pairs) / cov0, abs_tol=1e-9)
            else:
                assert got[lag].covariance is None
    none = windows.autocorrelation(signal.limit(0), whole(spark), 2).collect()
    assert [(r.lag, r.n, r.correlation) for r in sorted(none)] == [(0, 0, None), (1, 0, None), (2, 0, None)]


def test_sax_windows(spark):
    signal, bases = track(spark, 8)
    plain = sorted(map(tuple, shapes.sax_words(signal, whole(spark), 4).collect()))
    mean, sd = statistics.fmean(bases.values()), statistics.stdev(bases.values())
    for window in (3, 50):
        got = sorted(map(tuple, shapes.sax_words(signal, whole(spark), 4, window=window).collect()))
        assert [r[:3] for r in got] == [r[:3] for r in plain]
        for chrom, s, e, word in got:
            z = [(statistics.fmean(bases[chrom, p] for p in range(a, min(e, a + window))) - mean) / sd for a in range(s, e, window)]
            breaks = [statistics.NormalDist().inv_cdf(i / 4) for i in (1, 2, 3)]
            assert word == "".join("ACGT"[sum(x >= b for b in breaks)] for x in z)
    with pytest.raises(ValueError, match="window"):
        shapes.sax_words(signal, whole(spark), 4, window=0)


@pytest.mark.parametrize(("size", "max_na", "tile"), [(15, 0.4, 16), (1, 0.0, 1 << 14), (60, 0.7, 32)])
def test_random_places(spark, size, max_na, tile):
    signal, bases = track(spark, 21)
    sections = spark.createDataFrame([(1, "a", 5, 200), (2, "a", 190, 390), (3, "b", 0, 400), (4, "b", 30, 31)], "section_id long, chrom string, start long, end long")
    black = spark.createDataFrame([("a", 100, 120), ("b", 0, 3)], "chrom string, start long, end long")
    got = {(r.chrom, p) for r in shapes.random_places(signal, sections, size, max_na, black, tile).collect() for p in range(r.start, r.end)}
    want, barred = set(), [("a", 100, 120), ("b", 0, 3)]
    for _, c, s, e in sections.collect():
        for p in range(s, e - size + 1):
            gaps = sum((c, q) not in bases for q in range(p, p + size))
            if gaps <= max_na * size and not any(b == c and bs < p + size and p < be for b, bs, be in barred):
                want.add((c, p))
    assert got == want


def test_random_regions_are_as_many_as_asked_for(spark):
    """One base in a hundred has data, in few stretches."""
    signal = spark.createDataFrame([("a", i * 5000, i * 5000 + 50, 1.0) for i in range(20)], SCHEMA)
    one = sections_of(spark.createDataFrame([("a", 100_000)], "chrom string, size long"))
    got = shapes.random_regions(signal, one, 20, 40).collect()
    assert len({r.start for r in got}) == 20 and all(sum(0 <= p % 5000 < 50 for p in range(r.start, r.end)) >= 24 and r.end - r.start == 40 for r in got)
    assert set(got) == set(shapes.random_regions(signal, one, 20, 40).collect()) and set(got) != set(shapes.random_regions(signal, one, 20, 40, seed=2).collect())
    places = sum(r.end - r.start for r in shapes.random_places(signal, one, 40).collect())
    assert len(set(shapes.random_regions(signal, one, places, 40).collect())) == places
    with pytest.raises(ValueError, match="only"):
        shapes.random_regions(signal, one, places + 1, 40)
    spread = np.array([r.start // 5000 for r in shapes.random_regions(signal, one, 300, 40).collect()])
    assert len(np.unique(spread)) == 20 and np.bincount(spread).max() < 40


def greedy(points, sep):
    """Best first, ties to the left."""
    kept = []
    for pos, _ in sorted(points, key=lambda x: (-x[1], x[0])):
        if all(abs(pos - p) >= sep for p in kept):
            kept.append(pos)
    return sorted(kept)


@pytest.mark.parametrize(("sep", "shape"), [(10, "random"), (40, "ties"), (25, "ramp"), (1, "random")])
def test_points_kept_apart(spark, sep, shape):
    """A cluster as long as the axis; a ramp is decided from its top, one after the other, so its rest is left to the last step."""
    rng = random.Random(4)
    at = sorted(rng.sample(range(4000), 900))
    value = {"random": lambda i: rng.random(), "ties": lambda i: float(rng.randrange(3)), "ramp": lambda i: float(i)}[shape]
    points = [(p, value(i)) for i, p in enumerate(at)]
    rows = [("a", "+", p, v) for p, v in points] + [("a", "-", p, -v) for p, v in points[:300]]
    df = spark.createDataFrame(rows, "chrom string, strand string, pos long, value double")
    got = shapes.kept_apart(df, sep).collect()
    assert sorted(r.pos for r in got if r.strand == "+") == greedy(points, sep)
    assert sorted(r.pos for r in got if r.strand == "-") == greedy(points[:300], sep)
    if shape == "random":
        state = df.where("strand = '+'").withColumn("kept", F.lit(False))
        for _ in range(3):
            state = shapes.local_winners(state, sep)
        assert state.where("not kept").count() < 90


def test_bigwig_sections_in_columns(tmp_path):
    import struct
    import zlib

    from sparsetrack.sources import bigwig

    for order in "<>":
        head = lambda kind, n, o=order: struct.pack(o + "IIIIIBBH", 3, 100, 200, 10, 4, kind, 0, n)
        one = head(1, 2) + struct.pack(order + "IIfIIf", 5, 9, 1.5, 12, 13, -2)
        two = head(2, 2) + struct.pack(order + "IfIf", 7, 0.25, 70, 8)
        three = head(3, 3) + struct.pack(order + "fff", 1, float("nan"), 3)
        plain = [[c if isinstance(c, int) else c.tolist() for c in bigwig.columns(x, order)] for x in (one, two)]
        assert plain == [[3, [5, 12], [9, 13], [1.5, -2.0]], [3, [7, 70], [11, 74], [0.25, 8.0]]]
        _, start, end, value = bigwig.columns(three, order)
        assert (start.tolist(), end.tolist(), value.tolist()[::2]) == ([100, 110, 120], [104, 114, 124], [1.0, 3.0])
        path, blocks = tmp_path / "x", []
        with path.open("wb") as f:
            for x in (one, two, three):
                f.write(b"?" * 7)
                z = zlib.compress(x)
                blocks.append((f.tell(), len(z)))
                f.write(z)
        part = bigwig.Section(str(path), order, {3: "c"}, blocks, True)
        batches = list(bigwig.Reader(str(path), 1).read(part))
        assert len(batches) == 1 and batches[0].num_rows == 6 and batches[0].column("chrom").to_pylist() == ["c"] * 6  # without the missing value
    assert [len(x) for x in bigwig.ranges([(0, 10), (10, 10), (100_000, 5), (100_005, 5), (8_488_000, 1_000_000)])] == [2, 2, 1]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_chains_cut_into_splits(spark, tmp_path, split):
    from sparsetrack.sources import text

    rng, files = random.Random(1), []
    for name in ("one", "two"):
        lines = ["# a comment", ""]
        for i in range(6):
            lines.append(f"chain 10 c{i} 90000 {'+'} {i * 100} 80000 d{name} 70000 {'+-'[i % 2]} {i * 7} 60000" + (f" {i}" if i else ""))
            lines += [f"{rng.randrange(1, 90)}{sep}{rng.randrange(9)}{sep}{rng.randrange(9)}" for sep in ("\t", "  ") for _ in range((1, 60, 3, 0, 200, 9)[i])] + [str(rng.randrange(1, 50)), ""]
        (tmp_path / f"{name}.chain").write_text("\n".join(lines))
        files += text.chain_rows(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = text.read_chain(spark, str(tmp_path))
        assert got.columns == "chain_id t_name t_start t_end q_name q_start q_size q_strand chain_t_start chain_t_end".split()
        assert sorted(map(tuple, got.collect())) == sorted(files)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_command_line(spark, tmp_path):
    from sparsetrack import cli

    (tmp_path / "x.bg").write_text("".join(f"chr\t{i}\t{i + 1}\t{i % 4}\n" for i in range(40)))
    (tmp_path / "black.bed").write_text("chr\t0\t20\n")
    run = lambda line: cli.main(line.replace("@", f"{tmp_path}/").split(), spark=spark) or (tmp_path / "out").read_text().splitlines()
    got = run("autocorr 4 @x.bg @out")
    assert got[0] == "#lag\tn\tcovariance\tcorrelation" and got[1] == "0\t40\t1.250000\t1.000000" and [r.split("\t")[1] for r in got[1:]] == ["40", "39", "38", "37", "36"]
    assert run("sax 4 @x.bg @out -sax-window=4")[-1] == "G" * 10
    rows = [r.split("\t") for r in run("random 5 6 @x.bg @out -blacklist=@black.bed -NA-perc=0")]
    assert len(rows) == 5 and all(int(r[1]) >= 20 and int(r[2]) - int(r[1]) == 6 for r in rows)
    with pytest.raises(SystemExit):
        run("sax 4 @x.bg @out -sax-window=4 -bed4")
