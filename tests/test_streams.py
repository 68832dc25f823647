"""Stretches of streams against the batch result, in any order of arrival."""

import random

import numpy as np
import pytest

from sparsetrack.plans.intervals import merge
from sparsetrack.streaming.stretches import joined, stream_stretches

SCHEMA = "chrom string, start long, end long, ts timestamp"


def test_joined():
    start, end = joined(np.array([5, 0, 9, 3, 20, 21]), np.array([6, 3, 12, 5, 30, 22]))
    assert (start.tolist(), end.tolist()) == ([0, 9, 20], [6, 12, 30])
    assert [len(x) for x in joined(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), s, s + rng.randrange(1, 9), f"2024-01-01 00:00:{rng.randrange(60):02d}") for s in (rng.randrange(300) for _ in range(90))]
    runs = spark.createDataFrame(rows, "chrom string, start long, end long, ts string").selectExpr("chrom", "start", "end", "cast(ts as timestamp) as ts")
    want = sorted(map(tuple, merge(runs).collect()))
    rng.shuffle(rows)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    late = [("z", 0, 1, "2024-01-02 00:00:00")], [("z", 0, 1, "2024-01-03 00:00:00")]  # move the watermark on
    for part in (rows[:40], rows[40:41], rows[41:], *late):
        df = spark.createDataFrame(part, "chrom string, start long, end long, ts string").selectExpr("chrom", "start", "end", "cast(ts as timestamp) as ts")
        df.coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(SCHEMA).parquet(source)
        q = stream_stretches(live, "1 hour", 64).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", sink).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(sink).where("chrom <> 'z'")
    pieces = got.collect()
    assert all(r.start // 64 == (r.end - 1) // 64 == r.tile for r in pieces)
    assert sorted(map(tuple, merge(got).collect())) == want
