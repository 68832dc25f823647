"""Zoom levels: written, read back, and equal to a full scan."""

import math
import random

from sparsetrack.operators import summaries
from sparsetrack.plans.intervals import sections_of
from sparsetrack.sources import bigwig

SCHEMA = "chrom string, start long, end long, value double"


def test_pyramid(spark, tmp_path):
    rng, rows = random.Random(2), []
    for chrom, size in (("a", 30_000), ("b", 1_234), ("c", 5)):
        at = 0
        while at < size:
            end = min(size, at + rng.randrange(1, 4))
            rows.append((chrom, at, end, rng.randrange(-800, 800) / 8))
            at = end + rng.choice([0, 0, 3, 90])
    signal = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sizes = spark.createDataFrame([("a", 30_000), ("b", 1_234), ("c", 5)], "chrom string, size long")
    path = str(tmp_path / "x.bw")
    bigwig.write_bigwig(signal, sizes, path)
    assert bigwig.bigwig_zooms(path) == [100, 1000, 10_000]
    assert sorted(map(tuple, bigwig.read_bigwig(spark, path).collect())) == sorted(rows)
    for width in (100, 500, 2000, 30_000):
        full = summaries.summary(signal, width, sections_of(sizes), with_sum=True, median=False).where("num_data > 0")
        want = {(r.chrom, r.start, r.end): r for r in full.collect()}
        got = {(r.chrom, r.start, r.end): r for r in bigwig.zoomed_tiles(spark, path, width).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert (r.num_data, r.min, r.max) == (want[k].num_data, want[k].min, want[k].max)
            assert math.isclose(r.sum, want[k].sum, rel_tol=1e-6, abs_tol=1e-2) and math.isclose(r.mean, want[k].mean, rel_tol=1e-6, abs_tol=1e-4)
    assert bigwig.zoomed_tiles(spark, path, 70) is None and bigwig.zoomed_graph(spark, path, 70) is None
    full = {(r.chrom, r.middle): r["mean"] for r in summaries.chromgraph(signal, sections_of(sizes), 700).collect()}
    graph = {(r.chrom, r.middle): r["mean"] for r in bigwig.zoomed_graph(spark, path, 700).collect()}
    assert graph.keys() == full.keys() and all(math.isclose(graph[k], full[k], rel_tol=1e-6, abs_tol=1e-4) for k in full)
    cells = bigwig.read_zoom(spark, path, 100).where("chrom = 'b' and start < 300 and end > 200").collect()
    assert 0 < len(cells) <= 2 and all(r.chrom == "b" for r in cells)


def test_no_levels_for_a_short_axis(spark, tmp_path):
    path = str(tmp_path / "y.bw")
    bigwig.write_bigwig(spark.createDataFrame([("a", 0, 3, 1.5)], SCHEMA), spark.createDataFrame([("a", 5)], "chrom string, size long"), path)
    assert bigwig.bigwig_zooms(path) == [] and bigwig.read_bigwig(spark, path).count() == 1
