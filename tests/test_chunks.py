"""Chunks of stretches (split) against a fold over all stretches in order."""

import random

import pytest

from sparsetrack.operators import shapes


def folded(stretches, size, min_gap):
    """Plain: what a chunk holds, stretch by stretch."""
    out, number, held, before = {}, 0, 0, None
    for chrom, s, e in sorted(stretches):
        same = before is not None and before[0] == chrom
        gap = s - before[1] if same else 0
        if before is not None and held + gap + e - s > size and (gap >= min_gap or not same):
            number, held = number + 1, e - s
        else:
            held += gap + e - s
        lo, _ = out.get((number, chrom), (s, e))
        out[number, chrom] = lo, e
        before = chrom, e
    return sorted((n, c, lo, hi) for (n, c), (lo, hi) in out.items())


@pytest.mark.parametrize("seed,size,min_gap,tile", [(1, 40, 1, 64), (2, 200, 4, 50), (3, 1, 1, 1000), (4, 90, 30, 16), (5, 10**6, 1, 100)])
def test_against_a_fold(spark, seed, size, min_gap, tile):
    rnd = random.Random(seed)
    stretches = []
    for chrom in ("a", "b", "c", "d"):
        at = rnd.randint(0, 1000)
        for _ in range(1 if chrom == "b" else rnd.randint(20, 60)):
            at += rnd.choice([1, 1, 2, 5, 40, 300])
            end = at + rnd.choice([1, 3, 10, 120])
            stretches.append((chrom, at, end))
            at = end
    runs = [(c, lo, hi, 1.0) for c, s, e in stretches for lo, hi in ([(s, e)] if e - s < 4 else [(s, s + 2), (s + 2, e)])]
    rnd.shuffle(runs)
    signal = spark.createDataFrame(runs, "chrom string, start long, end long, value double").repartition(5)
    got = sorted(tuple(r) for r in shapes.split_chunks(signal, size, min_gap, tile).select("chunk", "chrom", "start", "end").collect())
    assert got == folded(stretches, size, min_gap)


def test_no_signal(spark):
    assert shapes.split_chunks(spark.createDataFrame([], "chrom string, start long, end long, value double"), 10).count() == 0
