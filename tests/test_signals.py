"""Small signals with known answers, sources and sinks, streams."""

import io
import struct

import numpy as np
import pytest

from sparsetrack import cli
from sparsetrack.operators import filters, profiles, shapes, summaries, windows
from sparsetrack.operators.lift import lift
from sparsetrack.plans.intervals import condense, merge, sections_of, subtract
from sparsetrack.sources import bigwig, sinks, text
from sparsetrack.streaming.tiles import stream_tiles

VALUES = [1, 2, 3, 3, 5, 4, 4, None, None, 7, 6, 8, 0, 2, 2, 9]


@pytest.fixture(scope="module")
def s(spark):
    return spark.createDataFrame([("c", i, i + 1, float(v)) for i, v in enumerate(VALUES) if v is not None], "chrom string, start long, end long, value double")


@pytest.fixture(scope="module")
def sec(spark):
    return sections_of(spark.createDataFrame([("c", 16)], "chrom string, size long"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_runs_and_bases_agree(s, sec):
    a, b = (summaries.summary(x, 5, sec, quantiles=True, squares=True).drop("section_id").orderBy("start").collect() for x in (s, condense(s)))
    # deviations around a mean are summed in another order
    plain = lambda r: {k: v for k, v in r.asDict().items() if k != "chrom"}
    assert len(a) == len(b) and all(x.chrom == y.chrom and plain(x) == pytest.approx(plain(y), rel=1e-12) for x, y in zip(a, b))
    assert a[1].num_data == 3 and a[1].median == 4.0


def test_threshold_fill_shift_mask(s, sec, spark):
    assert rows(filters.find_threshold(condense(s), "more", 2.5), "start", "end") == [(2, 7), (9, 12), (15, 16)]
    filled = filters.fill(condense(s), sec, -1)
    assert sum(r.end - r.start for r in filled.collect()) == 16
    back = filters.shift(filters.shift(condense(s), sec, 4), sec, -4)
    assert rows(subtract(back, spark.createDataFrame([("c", 12, 16)], "chrom string, start long, end long")), "start", "end", "value") == rows(filters.remove_mask(condense(s), spark.createDataFrame([("c", 12, 16)], "chrom string, start long, end long")), "start", "end", "value")
    assert rows(condense(condense(s)), "start", "end") == rows(condense(s), "start", "end")
    assert rows(merge(s, tile=4), "start", "end") == rows(merge(s), "start", "end") == [(0, 7), (9, 16)]
    with pytest.raises(ValueError):
        filters.find_threshold(s, "nope", 1)


def test_windows(s, sec, monkeypatch):
    whole = rows(windows.window(s, sec, 5, 2), "start", "values")
    monkeypatch.setattr(windows.haloed, "__defaults__", (3,))
    assert rows(windows.window(s, sec, 5, 2), "start", "values") == whole and len(whole) == 6
    got = {r.start: r.value for r in windows.roll(s, sec, "mean", 4).collect()}
    for i in range(13):
        v = [x for x in VALUES[i : i + 4] if x is not None]
        assert got.get(i + 2) == (pytest.approx(sum(v) / len(v)) if len(v) >= 2 else None)


def test_extrema_words_split(s, sec):
    assert rows(shapes.local_extrema(s), "pos", "strand") == [(4, "+"), (10, "-"), (11, "+"), (12, "-")]
    assert rows(shapes.local_extrema(s, min_sep=8, kind="maxima"), "pos") == [(11,)]
    assert [len(w) for (w,) in rows(shapes.sax_words(s, sec, 4), "word")] == [7, 7]
    assert rows(shapes.split_chunks(s, 8), "chunk", "start", "end") == [(0, 0, 7), (1, 9, 16)]
    assert shapes.random_regions(s, sec, 3, 4).count() == 3


def test_profiles(s, spark):
    r = spark.createDataFrame([(0, "c", 2, 6, "a", "+"), (1, "c", 9, 14, "b", "-"), (2, "c", -3, 1, "x", "+")], "row_id long, chrom string, start long, end long, name string, strand string")
    m = {x.row_id: x["values"] for x in profiles.matrix(r, {"s": s}, 2, 2, "starts").collect()}
    assert m == {0: [1.0, 2.0, 3.0, 3.0], 1: [9.0, 2.0, 2.0, 0.0], 2: [None, None, None, None]}
    assert {x.row_id: x["values"] for x in profiles.extract(s, r).collect()}[1] == [2.0, 0.0, 8.0, 6.0, 7.0]
    assert rows(profiles.maxima(s, r), "row_id", "maximum", "offsets") == [(0, 5.0, [2]), (1, 8.0, [2]), (2, 1.0, [3])]
    assert len({x.offset for x in profiles.meta_vectors(r, s, 2, 3, 2).collect()}) == 7
    f = profiles.fuse(profiles.matrix(r, {"s": s}, 1, 1), profiles.matrix(r, {"s": s}, 1, 1))
    assert all(len(x["values"]) == 4 for x in f.collect())
    got, centres = profiles.cluster(profiles.matrix(r, {"s": s}, 2, 2, fill=0.0), 2)
    assert len(centres) == 2 and got.count() == 3


def test_lift(s, spark):
    chain = "chain 1 c 16 + 0 12 d 20 - 2 13 7\n4 1 0\n7\n\nchain 1 c 16 + 12 14 d 20 + 9 11 8\n2\n"
    blocks = spark.createDataFrame(list(text.chain_rows(chain.splitlines())), "chain_id string, t_name string, t_start long, t_end long, q_name string, q_start long, q_size long, q_strand string, chain_t_start long, chain_t_end long")
    up, rest = lift(s, blocks)
    assert rows(rest, "pos", "reason") == [(4, "problem"), (9, "multi_mapped"), (12, "multi_mapped"), (14, "deleted"), (15, "deleted")]
    assert (17, 1.0) in rows(up, "start", "value")


def test_texts_and_binary(s, sec, spark, tmp_path):
    for kind in ("bg", "var", "fix"):
        out = io.StringIO()
        sinks.write_wig(condense(s), out, kind, 3)
        p = tmp_path / f"{kind}.wig"
        p.write_text(out.getvalue())
        assert rows(condense(text.read_wig(spark, str(p))), "start", "end", "value") == rows(condense(s), "start", "end", "value")
    path = str(tmp_path / "x.bw")
    bigwig.write_bigwig(s, spark.createDataFrame([("b", 5), ("c", 16)], "chrom string, size long"), path)
    back = bigwig.read_bigwig(spark, path)
    assert rows(back, "chrom", "start", "end", "value") == rows(s, "chrom", "start", "end", "value")
    assert rows(back.where("chrom = 'c' and start < 3"), "start") == [(0,), (1,), (2,)]
    assert rows(bigwig.bigwig_sizes(spark, path), "chrom", "size") == [("b", 5), ("c", 16)]
    assert sinks.number(0.125, 2) == "0.12" and sinks.number(None, 2) == "NA"
    bed = tmp_path / "r.bed"
    bed.write_text("c\t2\t6\tn\nc\t9\t14\tm\t3\t-\n")
    r = text.read_bed(spark, str(bed))
    m = profiles.matrix(r, {"s": s}, 2, 2)
    sinks.write_matrix(m, str(tmp_path / "m.bin"), labels=True)
    assert sinks.read_matrix(str(tmp_path / "m.bin")).shape == (2, 4)
    assert struct.unpack("<9Q", (tmp_path / "m.bin").read_bytes()[:72])[8] == 8192
    assert np.isfinite(sinks.read_matrix(str(tmp_path / "m.bin"))).all()


def test_many_sections(spark, tmp_path):
    n = 300_000
    big = spark.range(n).selectExpr("'c' as chrom", "id as start", "id + 1 as end", "cast(id % 7 as double) as value")
    path = str(tmp_path / "big.bw")
    bigwig.write_bigwig(big, spark.createDataFrame([("c", n)], "chrom string, size long"), path)
    assert bigwig.read_bigwig(spark, path).where("chrom = 'c' and start < 250010 and end > 250000").count() == 10


def test_command_line(s, spark, tmp_path):
    with open(tmp_path / "a.wig", "w") as f:
        sinks.write_wig(s, f, "bg")
    run = lambda *a: cli.main([str(x) for x in a], spark)
    wig, out = tmp_path / "a.wig", tmp_path / "out"
    run("find", "more", 2.5, wig, out)
    assert out.read_text() == "c\t2\t7\nc\t9\t12\nc\t15\t16\n"
    run("summary", 8, wig, out, "-header")
    assert out.read_text().splitlines()[1] == "c\t0\t8\t8\t7\t1.00\t5.00\t3.14\t3.00"
    run("dist", wig, out)
    assert out.read_text().splitlines()[:3] == ["0\t1", "1\t1", "2\t3"]
    run("remove", "less", 3, wig, out, "-wigtype", "bg")
    assert out.read_text().splitlines()[0] == "c\t2\t3\t3.00"
    (tmp_path / "r.bed").write_text("c\t2\t6\tn\n")
    run("matrix", "2:2", tmp_path / "r.bed", wig, out)
    assert out.read_text() == "3.00\t3.00\t5.00\t4.00\n"
    run("agg", "2:2", tmp_path / "r.bed", wig, out)
    assert out.read_text().splitlines()[0] == "-2\t3.000000"


def test_stream(s, spark, tmp_path):
    s.repartition(2).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = stream_tiles(live, 8).writeStream.outputMode("complete").format("memory").queryName("tiles").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tiles"), "start", "num_data") == [(0, 7), (8, 7)]


RUNS = "chrom string, start long, end long, value double"


def test_second_moments_do_not_cancel(spark):
    v = spark.createDataFrame([("c", i, i + 1, 1e8 + i % 3) for i in range(30)], RUNS)
    r = spark.createDataFrame([("c", 0, 30)], "chrom string, start long, end long")
    assert summaries.summary(v, r, squares=True).first().sum_squares == pytest.approx(20, abs=1e-9)
    assert summaries.summary(v, r, squares=True, total=True).first().sum_squares == pytest.approx(20, abs=1e-9)
    assert summaries.whole(v).first()["std"] == pytest.approx((20 / 29) ** 0.5, abs=1e-12)
    with pytest.raises(ValueError):
        summaries.summary(v, r, fill=0.0, total=True)


def test_distribution_of_a_wide_range(spark):
    v = spark.createDataFrame([("c", 0, 5, -2.5), ("c", 9, 10, 3e7)], RUNS)
    d = summaries.distribution(v)
    assert d.count() == 30_000_003 and rows(d.where("count > 0"), "bin", "count") == [(-2, 5), (30_000_000, 1)]
    assert summaries.distribution(v.limit(0)).count() == 0


def test_a_whole_chromosome(spark):
    """Two hundred and fifty million bases, nearly all without data."""
    n = 250_000_000
    sec = sections_of(spark.createDataFrame([("c", n)], "chrom string, size long"))
    v = spark.createDataFrame([("c", 5_000_000, 5_000_003, 2.0), ("c", 249_999_999, n, 1.0)], RUNS)
    assert rows(windows.roll(v, sec, "total", 3, max_na=0), "start", "value") == [(5_000_001, 6.0)]
    assert rows(windows.window(v, sec, 2, skip_na=True), "start") == [(5_000_000,), (5_000_001,)]
    assert rows(windows.paste({"a.x": v, "b": v}, sec, skip_na=True), "pos", "a.x", "b") == [(p, x, x) for p, x in ((5_000_000, 2.0), (5_000_001, 2.0), (5_000_002, 2.0), (249_999_999, 1.0))]
    runs = windows.paste_runs({"a": v, "b": v.limit(1)}, sec)
    assert runs.selectExpr("sum(end - start)").first()[0] == n
    empty = v.limit(0)
    assert windows.roll(empty, sec, "mean", 24).count() == 0
    assert filters.find_threshold(spark.createDataFrame([("c", 0, n, 1.0)], RUNS), "more", 0).first()["end"] == n


def test_depth_and_merge_across_tiles(spark):
    from sparsetrack.plans.intervals import depth

    r = spark.createDataFrame([("c", 2, 50), ("c", 10, 20), ("c", 15, 33), ("c", 60, 61), ("d", 0, 4)], "chrom string, start long, end long")
    deep = {p: x.depth for x in depth(r, 8).collect() if x.chrom == "c" for p in range(x.start, x.end)}
    assert deep == {p: (2 <= p < 50) + (10 <= p < 20) + (15 <= p < 33) + (p == 60) for p in range(61) if 2 <= p < 50 or p == 60}
    assert rows(merge(r, tile=8), "chrom", "start", "end") == [("c", 2, 50), ("c", 60, 61), ("d", 0, 4)]


def test_paste_of_changing_runs(s, sec, spark):
    other = spark.createDataFrame([("c", 1, 9, 4.0), ("c", 9, 11, 5.0), ("c", 15, 16, 1.0)], RUNS)
    got = {r.pos: (r.a, r.b) for r in windows.paste({"a": condense(s), "b": other}, sec).collect()}
    assert got == {p: (None if VALUES[p] is None else float(VALUES[p]), 4.0 if 1 <= p < 9 else 5.0 if 9 <= p < 11 else 1.0 if p == 15 else None) for p in range(16)}
    filled = windows.paste({"a": s, "b": other}, sec, fill=0.5).where("b = 0.5")
    assert filled.count() == 5


def test_text_in_blocks(spark, tmp_path):
    """A step line holds in the blocks after its own, however small these are."""
    lines = ["track type=wiggle_0", "fixedStep chrom=c start=3 step=2 span=1", *(str(i) for i in range(400)), "variableStep chrom=d span=2", *(f"{5 * i + 1}\t{i}" for i in range(300)), "e\t7\t9\t1.5"]
    (tmp_path / "a.wig").write_text("\n".join(lines) + "\n")
    want = sorted(text.signal_rows(lines))
    for size in ("134217728", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert rows(text.read_wig(spark, str(tmp_path / "a.wig")), "chrom", "start", "end", "value") == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_random_regions_without_data(s, sec):
    assert shapes.random_regions(s.limit(0), sec, 3, 4, max_na=1.0).count() == 3
    assert shapes.random_regions(s.limit(0), sec, 3, 4).count() == 0


def test_lift_runs(spark):
    chain = "chain 1 c 100 + 0 40 d 90 + 10 50 1\n40\n\nchain 1 c 100 + 30 60 d 90 - 0 30 2\n30\n\nchain 1 c 100 + 70 80 d 90 + 45 55 3\n10\n"
    kinds = "chain_id string, t_name string, t_start long, t_end long, q_name string, q_start long, q_size long, q_strand string, chain_t_start long, chain_t_end long"
    blocks = spark.createDataFrame(list(text.chain_rows(chain.splitlines())), kinds)
    one = spark.createDataFrame([("c", 0, 90, 1.0)], RUNS)
    each = spark.createDataFrame([("c", p, p + 1, 1.0) for p in range(90)], RUNS)
    bases = lambda df: sorted((r["chrom"], p, r["value"]) for r in df.collect() for p in range(r["start"], r["end"]))
    (a, left), (b, rest) = lift(one, blocks), lift(each, blocks)
    assert bases(a) == bases(b) and rows(left, "pos", "reason") == rows(rest, "pos", "reason")
    target = {}
    for p in range(90):
        hits = [10 + p] * (p < 40) + [89 - (p - 30)] * (30 <= p < 60) + [45 + p - 70] * (70 <= p < 80)
        if len(hits) == 1:
            target.setdefault(hits[0], []).append(p)
    assert bases(a) == [("d", q, 1.0) for q in sorted(target) if len(target[q]) == 1]
    assert {r.pos for r in left.where("reason = 'multi_mapped'").collect()} == {p for ps in target.values() if len(ps) > 1 for p in ps}
    small = spark.createDataFrame([("d", 20)], "chrom string, size long")
    up, left = lift(one, blocks, small)
    assert all(q < 20 for _, q, _ in bases(up)) and left.where("reason = 'off_end'").count() == len([q for q, ps in target.items() if len(ps) == 1 and q >= 20])
