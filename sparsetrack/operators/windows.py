"""Sliding and rolling windows, autocorrelation, several signals side by side.

Frames run inside tiles of a section, each with a halo of the frame's reach, so a long section is dealt to many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import SMALL, bases, clip, cover, cut_at, dense, merge, overlaps
from .summaries import whole

TILE = 1 << 16


def haloed(grid: DataFrame, before: int, after: int, tile: int = TILE) -> DataFrame:
    """Rows by tile, with copies of neighbours within reach; ``own`` marks the tile's rows themselves."""
    rel = F.col("pos") - F.col("s_start")
    first, last = F.floor(F.greatest(rel - after, F.lit(0)) / tile), F.floor((rel + before) / tile)
    return grid.withColumn("tile", F.explode(F.sequence(first, last))).withColumn("own", F.floor(rel / tile) == F.col("tile"))


def window(signal: DataFrame, sections: DataFrame, size: int, step: int = 1, skip_na: bool = False, centre: bool = False, fill: float | None = None) -> DataFrame:
    """(section_id, chrom, start, end, values) for windows of ``size`` bases every ``step``.

    ``skip_na`` leaves out windows with gaps; the steps then count from the start of each gap-free stretch.
    ``centre`` gives the middle ``step`` bases as start and end.
    """
    if skip_na and fill is not None:
        raise ValueError("filled windows have no gaps to skip")
    if skip_na:
        rows = clip(signal, sections)
        runs = merge(rows, ("section_id", "chrom"))
        grid = bases(runs.withColumn("s_start", F.col("start")).withColumn("s_end", F.col("end"))).join(bases(rows).select("section_id", "pos", "value"), ["section_id", "pos"])
    else:
        grid = dense(signal, sections, fill)
    w = Window.partitionBy("section_id", "s_start", "tile").orderBy("pos").rowsBetween(0, size - 1)
    packed = F.collect_list(F.struct("pos", "value")).over(w)
    rows = haloed(grid, 0, size - 1).withColumn("x", packed).where("own").where((F.size("x") == size) & ((F.col("pos") - F.col("s_start")) % step == 0))
    start = F.col("pos") + (size // 2 - step // 2 if centre else 0)
    return rows.select("section_id", "chrom", start.alias("start"), (start + (step if centre else size)).alias("end"), F.transform("x", lambda r: r["value"]).alias("values"))


def roll(signal: DataFrame, sections: DataFrame, fn: str, size: int, step: int = 1, max_na: int | None = None, min_mean: float | None = None, fill: float | None = None) -> DataFrame:
    """(section_id, chrom, start, end, value): mean or total of the ``size`` bases around each place.

    A window needs to lie in its section, to have at most ``max_na`` bases without data (half the size by default) and
    some with, and a mean of at least ``min_mean``.
    """
    if fn not in ("mean", "total"):
        raise ValueError(f"unknown function: {fn}")
    limit = size // 2 if max_na is None else (size - 1 if max_na > size else max_na)
    o = size // 2 - step // 2
    here = F.struct(F.col("section_id"), F.col("start").alias("s_start"))  # of the section; steps count from its start
    inside = sections.select(here.alias("section_id"), "chrom", "start", "end")
    if fill is None:  # only windows near data can have some; what is near holds such windows whole
        reach = clip(signal, inside).withColumn("start", F.col("start") - size + 1).withColumn("end", F.col("end") + size - 1)
        inside = overlaps(merge(reach, ("section_id", "chrom")).withColumnRenamed("section_id", "mine"), inside).where("mine = r_section_id")
        inside = inside.select(F.col("mine").alias("section_id"), "chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end"))
    tile = max(TILE, size)
    # A stretch is laid out in blocks as long as a window, which is then the end of one block and the beginning of the next:
    # two running sums, whatever the size, and nothing is subtracted.
    rel = F.col("pos") - F.col("s_start")
    grid = haloed(dense(signal, inside, fill), 0, size - 1, tile).withColumn("block", F.floor(rel / size))
    part = ["section_id", "chrom", "s_start", "tile"]
    block = Window.partitionBy(*part, "block")
    run = lambda order: block.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {}
    for name, order in (("head", F.asc("pos")), ("tail", F.desc("pos"))):
        sums |= {f"{name}_n": F.count("value").over(run(order)), f"{name}_s": F.coalesce(F.sum("value").over(run(order)), F.lit(0.0))}
    ahead = Window.partitionBy(*part).orderBy("pos")
    aligned = rel % size == 0  # the window is the block
    rows = grid.withColumns(sums).withColumns({c: F.when(~aligned, F.lead(c, size - 1).over(ahead)) for c in ("head_n", "head_s")})
    rows = rows.withColumns({"n": F.col("tail_n") + F.coalesce("head_n", F.lit(0)), "s": F.col("tail_s") + F.coalesce("head_s", F.lit(0.0))})
    rows = rows.where("own").where((F.col("pos") + size <= F.col("s_end")) & ((F.col("pos") - F.col("section_id.s_start")) % step == 0) & (size - F.col("n") <= limit) & (F.col("n") > 0))
    mean = F.col("s") / F.col("n")
    if min_mean is not None:
        rows = rows.where(mean >= min_mean)
    value = mean if fn == "mean" else F.col("s")
    return rows.select("section_id.section_id", "chrom", (F.col("pos") + o).alias("start"), (F.col("pos") + o + step).alias("end"), value.alias("value"))


def autocorrelation(signal: DataFrame, sections: DataFrame, max_lag: int, tile: int = TILE) -> DataFrame:
    """(lag, n, covariance, correlation) for lags from 0 to ``max_lag``, over all pairs of bases with data so far apart in a section.

    The covariance is the mean product of deviations from the signal's mean (of its data within the sections); the correlation
    its share of that at lag 0, NULL if that is 0.  Lags without pairs have n 0 and NULLs.  Tiles, with a halo of ``max_lag``
    bases ahead, are multiplied with themselves by Fourier transforms of overlapping blocks; gaps count as 0 in a second
    product of presence, so they are counted out.
    """
    rows = overlaps(signal, sections).select(F.col("r_section_id").alias("section_id"), "chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end"), "value", F.col("r_start").alias("s_start"))
    mean = F.broadcast(whole(rows.select("chrom", "start", "end", "value")).select(F.coalesce("mean", F.lit(0.0)).alias("m")))  # one row
    rel = rows.select("section_id", "chrom", (F.col("start") - F.col("s_start")).alias("start"), (F.col("end") - F.col("s_start")).alias("end"), "value")
    each = rel.withColumn("tile", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - max_lag, F.lit(0)) / tile), F.floor((F.col("end") - 1) / tile))))
    first = F.col("tile") * tile
    each = each.select("section_id", "chrom", "tile", (F.greatest("start", first) - first).alias("start"), (F.least("end", first + tile + max_lag) - first).alias("end"), "value").where("end > start").crossJoin(mean)
    lags = max_lag + 1

    def products(t: pa.Table) -> pa.Table:
        x, have = np.zeros(tile + max_lag), np.zeros(tile + max_lag)
        for s, e, v in zip(t["start"].to_numpy(), t["end"].to_numpy(), (t["value"].to_numpy() - t["m"][0].as_py()), strict=True):
            x[s:e], have[s:e] = v, 1.0
        total, count = np.zeros(lags), np.zeros(lags)
        block = min(tile, max(1024, 4 * lags))  # blocks of the tile, each with what lies ahead of it
        for at in range(0, tile, block):
            to = min(at + block, tile)
            if have[at:to].any():
                width = 1 << (to - at + 2 * max_lag).bit_length()
                for y, out in ((x, total), (have, count)):
                    f, g = np.fft.rfft(y[at:to], width), np.fft.rfft(y[at : to + max_lag], width)
                    out += np.fft.irfft(np.conj(f) * g, width)[:lags]
        return pa.table({"lag": np.arange(lags), "n": np.rint(count).astype(np.int64), "s": total})

    sums = each.groupBy("section_id", "chrom", "tile").applyInArrow(products, "lag long, n long, s double").groupBy("lag").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = signal.sparkSession.range(lags).withColumnRenamed("id", "lag").join(sums, "lag", "left")  # lags + 1 rows at most
    cov = F.try_divide("s", "n")
    zero = sums.where("lag = 0").select(cov.alias("zero"))
    out = out.select("lag", F.coalesce("n", F.lit(0)).cast("long").alias("n"), cov.alias("covariance")).join(F.broadcast(zero), F.lit(True), "left")  # one row
    return out.select("lag", "n", "covariance", F.try_divide("covariance", "zero").alias("correlation"))


def paste_runs(signals: dict[str, DataFrame], sections: DataFrame) -> DataFrame:
    """(section_id, chrom, start, end, one column for each signal): stretches of the sections in which no signal changes."""
    rows = None
    for i, signal in enumerate(signals.values()):
        mine = cut_at(cover(signal, sections), SMALL)
        part = mine.select("section_id", "chrom", "tile", "start", *(F.struct("end", "value").alias(f"x{j}") if i == j else F.lit(None).cast("struct<end:bigint,value:double>").alias(f"x{j}") for j in range(len(signals))))
        rows = part if rows is None else rows.unionByName(part)
    # every signal covers a tile from its start, so each has a run wherever another begins one
    w = Window.partitionBy("section_id", "chrom", "tile").orderBy("start")
    x = [f"x{j}" for j in range(len(signals))]
    at = rows.select("section_id", "chrom", "start", F.lead("start").over(w).alias("next"), *(F.last(c, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias(c) for c in x))
    once = at.where(~F.col("start").eqNullSafe(F.col("next")))
    return once.select("section_id", "chrom", "start", F.least(*(F.col(c)["end"] for c in x)).alias("end") if len(x) > 1 else F.col("x0")["end"].alias("end"), *(F.col(c)["value"].alias(n) for c, n in zip(x, signals, strict=True)))


def paste(signals: dict[str, DataFrame], sections: DataFrame, skip_na: bool = False, skip_min: float | None = None, consts: dict[str, float] | None = None, means: bool = False, totals: bool = False, covs: bool = False, fill: float | None = None) -> DataFrame:
    """(section_id, chrom, pos, one column for each signal, constants): a row for each base of the sections.

    ``skip_na`` wants data in all signals; ``skip_min`` drops bases where one is smaller (no data is not).  Whole-signal
    means, totals and covered bases can stand beside them as constants.  Signals are laid side by side as runs; bases come last.
    """
    names = list(signals)
    inner = [f"s{i}" for i in range(len(names))]  # whatever the names hold
    runs = paste_runs(dict(zip(inner, signals.values(), strict=True)), sections)
    for n in inner:
        if fill is not None:
            runs = runs.withColumn(n, F.coalesce(n, F.lit(float(fill))))
        if skip_na:
            runs = runs.where(F.col(n).isNotNull())
        if skip_min is not None:
            runs = runs.where(~F.coalesce(F.col(n) < skip_min, F.lit(False)))
    extra = [F.lit(float(x)).alias(name) for name, x in (consts or {}).items()]
    out = bases(runs).select("section_id", "chrom", "pos", *(F.col(c).alias(n) for c, n in zip(inner, names, strict=True)), *extra)
    for n in names:
        cols = [c for c, on in (("mean", means), ("total", totals), ("covered", covs)) if on]
        if cols:  # one row
            out = out.crossJoin(F.broadcast(whole(signals[n]).select(*(F.col(c).cast("double").alias(f"{n}_{c}") for c in cols))))
    return out
