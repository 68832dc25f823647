"""Statistics of a signal: by region or tile, whole histograms, coarse graphs, whole-signal constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.intervals import overlaps, sections_of, tiled

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Parts into which the values of a long region are cut; regions of more bases than LONG count as long.
CUTS, LONG = 128, 1 << 20


def _stats(v: Column, w: Column, quantiles: tuple[float, ...], with_sum: bool, buffered: Column | None = None) -> list[Column]:
    """``q`` has the quantiles asked for, of rows that may be buffered."""
    out = [F.sum(w).alias("num_data"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * w) / F.sum(w)).alias("mean")]
    if quantiles:
        out.append(F.percentile(F.when(buffered, v), F.array(*map(F.lit, quantiles)), w).alias("q"))
    if with_sum:
        out.append(F.sum(v * w).alias("sum"))
    return out


def selected(pieces: DataFrame, keys: list[str], quantiles: tuple[float, ...], cuts: int = CUTS) -> DataFrame:
    """keys and ``q``: exact weighted quantiles (linear between ranks) of (keys, v, w), w whole numbers, without a buffer of values.

    Equal values become one.  A mergeable sketch cuts each key's values into about equal parts; the parts' weights tell in
    which the wanted ranks lie, and only those parts are sorted, each by itself.  A key may hold any share of the rows.
    """
    values = pieces.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    share = F.array(*(F.lit(i / cuts) for i in range(1, cuts)))
    sketch = values.groupBy(*keys).agg(F.percentile_approx("v", share, 10 * cuts).alias("cuts"), F.sum("w").alias("all"))
    if keys:
        both = values.join(sketch, keys)
    else:
        both = values.crossJoin(F.broadcast(sketch))  # one row
    parts = both.select(*keys, "v", "w", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("part"))
    weights = parts.groupBy(*keys, "part").agg(F.sum("w").alias("in_part"))
    up = Window.partitionBy(*keys) if keys else Window.partitionBy()
    weights = weights.withColumn("before", F.sum("in_part").over(up.orderBy("part")) - F.col("in_part"))  # as many rows as parts
    # quantile i lies between two ranks, counted from 0
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("all") - 1)).alias("at")) for i, q in enumerate(quantiles)))
    ranks = sketch.select(*keys, "all", F.explode(wanted).alias("x")).select(*keys, "all", "x.i", "x.at")
    ranks = ranks.withColumn("k", F.explode(F.array(F.floor("at"), F.least(F.floor("at") + 1, F.col("all") - 1))))
    hit = ranks.join(weights, keys) if keys else ranks.crossJoin(weights)
    hit = hit.where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("in_part")))
    few = hit.groupBy(*keys, "part").agg(F.min("before").alias("before"), F.collect_set("k").alias("ks"))  # two ranks for each quantile at most
    inside = parts.join(few, [*keys, "part"])
    upto = F.sum("w").over(Window.partitionBy(*keys, "part").orderBy("v")) + F.col("before")
    found = inside.withColumn("upto", upto).withColumn("k", F.explode("ks")).where((F.col("k") >= F.col("upto") - F.col("w")) & (F.col("k") < F.col("upto"))).select(*keys, "k", "v")
    x = ranks.join(found, [*keys, "k"])
    lerp = F.min("v") + (F.max("v") - F.min("v")) * (F.max("at") - F.floor(F.max("at")))
    each = x.groupBy(*keys, "i").agg(lerp.alias("value"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda r: r["value"]).alias("q"))


def _apart(pieces: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """The weighted sum of squared deviations from the mean, by key; a second pass, since a difference of squares cancels."""
    both = pieces.join(means, keys) if keys else pieces.crossJoin(F.broadcast(means))  # one row
    d = F.col("v") - F.col("mean")
    return both.groupBy(*keys).agg(F.sum(d * d * F.col("w")).alias("sum_squares"))


def summary(signal: DataFrame, regions: DataFrame | int, sections: DataFrame | None = None, quantiles: bool = False, with_sum: bool = False, squares: bool = False, median: bool = True, fill: float | None = None, zero_remove: float | None = None, total: bool = False, long: int = LONG) -> DataFrame:
    """A row per region (all its columns stay) or, for an integer, per tile of the sections.

    size, num_data (bases with data), min, max, mean, median; regions without data have NULL statistics and num_data 0.
    ``quantiles`` adds q10, q25, q75, q90 (linear interpolation); ``squares`` the sum of squared deviations; ``total`` pools all
    regions into one row, overlapping ones counted as often as they overlap.  ``zero_remove``: values nearer to 0 are no data.
    Regions of at most ``long`` bases keep their values in one buffer for the median and quantiles; longer ones, and the total,
    are put in order by many tasks (``selected``).  Both are exact.
    """
    if total and fill is not None:
        raise ValueError("a total over all regions can't be filled")
    if zero_remove is not None:
        signal = signal.where(F.abs("value") >= zero_remove)
    width = regions if isinstance(regions, int) else None
    regions = tiled(sections, width) if width else regions
    keys = regions.columns
    rid = F.struct(*keys)
    one = regions.withColumn("rid", rid).distinct()
    if width:  # runs are cut at the tiles' bounds; nothing is looked up
        met = overlaps(signal.select("chrom", "start", "end", "value"), sections.select("section_id", "chrom", "start", "end"))
        first = lambda c: F.col("r_start") + F.floor((c - F.col("r_start")) / width) * width
        met = met.withColumn("t", F.explode(F.sequence(first(F.col("o_start")), first(F.col("o_end") - 1), F.lit(width).cast("long"))))
        tile = F.struct(F.col("r_section_id").alias("section_id"), F.col("chrom"), F.col("t").alias("start"), F.least(F.col("t") + width, "r_end").alias("end"))
        pieces = met.select(tile.alias("rid"), F.col("value").alias("v"), (F.least("o_end", F.col("t") + width) - F.greatest("o_start", "t")).alias("w"))
    else:
        met = overlaps(one.select("rid", "chrom", "start", "end"), signal.select("chrom", "start", "end", "value"))
        pieces = met.select("rid", F.col("r_value").alias("v"), (F.col("o_end") - F.col("o_start")).alias("w"))
    if total:
        one = regions.withColumn("rid", rid).groupBy("rid").agg(F.count("*").alias("times"), F.sum(F.col("end") - F.col("start")).alias("size"))
        pieces = pieces.join(one.select("rid", "times"), "rid").withColumn("w", F.col("w") * F.col("times"))
    if fill is not None:
        have = pieces.groupBy("rid").agg(F.sum("w").alias("have"))
        size = one.select("rid", F.col("size") if total else (F.col("end") - F.col("start")).alias("size"))
        rest = size.join(have, "rid", "left").select("rid", F.lit(float(fill)).alias("v"), (F.col("size") - F.coalesce("have", F.lit(0))).alias("w")).where("w > 0")
        pieces = pieces.select("rid", "v", "w").union(rest)
    ordered = QUANTILES if quantiles else (0.5,) if median else ()
    if total:
        sizes = one.agg(F.sum("size").alias("size"))
        found = pieces.agg(*_stats(F.col("v"), F.col("w"), (), with_sum))
        if ordered:
            found = found.join(selected(pieces, [], ordered), F.lit(True), "left")
        if squares:
            found = found.crossJoin(_apart(pieces, found.select("mean"), []))
        out = sizes.crossJoin(found)  # one row each
    else:
        # a region's length bounds the values in its buffer
        far = F.col("rid.end") - F.col("rid.start") > long
        some = bool(ordered) and (width > long if width else not one.where(F.col("end") - F.col("start") > long).isEmpty())
        all_ = bool(width) and some
        found = pieces.groupBy("rid").agg(*_stats(F.col("v"), F.col("w"), () if all_ else ordered, with_sum, F.lit(True) if not some or all_ else ~far))
        if some:
            apart = selected(pieces if all_ else pieces.where(far), ["rid"], ordered)
            found = found.join(apart, "rid", "left") if all_ else found.join(apart.withColumnRenamed("q", "q2"), "rid", "left").withColumn("q", F.coalesce("q2", "q")).drop("q2")
        if squares:
            found = found.join(_apart(pieces, found.select("rid", "mean"), ["rid"]), "rid")
        out = regions.withColumn("rid", rid).withColumn("size", F.col("end") - F.col("start")).join(found, "rid", "left").drop("rid")
    out = out.withColumn("num_data", F.coalesce("num_data", F.lit(0)).cast("long"))
    if quantiles:
        out = out.select("*", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q10", "q25", "median", "q75", "q90")))).drop("q")
    elif median:
        out = out.withColumn("median", F.get("q", F.lit(0))).drop("q")
    return out


def whole(signal: DataFrame) -> DataFrame:
    """One row: mean, total, covered bases, smallest, largest, sample standard deviation."""
    rows = signal.select(F.col("value").alias("v"), (F.col("end") - F.col("start")).alias("w"))
    n, s = F.sum("w"), F.sum(F.col("v") * F.col("w"))
    found = rows.agg((s / n).alias("mean"), s.alias("total"), n.alias("covered"), F.min("v").alias("min"), F.max("v").alias("max"))
    both = found.crossJoin(_apart(rows, found.select("mean"), []))  # one row each
    return both.withColumn("std", F.sqrt(F.try_divide("sum_squares", F.col("covered") - 1))).drop("sum_squares")


def distribution(signal: DataFrame, mult: float = 1.0) -> DataFrame:
    """(bin, count): bases by their value times ``mult`` cut to an integer; bins between the extremes are all there."""
    bins = signal.groupBy((F.col("value") * mult).cast("long").alias("bin")).agg(F.sum(F.col("end") - F.col("start")).alias("count"))
    lo, hi = signal.agg(F.min((F.col("value") * mult).cast("long")), F.max((F.col("value") * mult).cast("long"))).first()  # two numbers
    few = bins.count() <= 1_000_000
    reach = signal.sparkSession.range(0 if lo is None else lo, 0 if lo is None else hi + 1).withColumnRenamed("id", "bin")
    return reach.join(F.broadcast(bins) if few else bins, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def chromgraph(signal: DataFrame, sections: DataFrame, every: int = 10_000) -> DataFrame:
    """(chrom, middle, mean) of every tile of the sections; a tile without data has 0."""
    s = summary(signal, every, sections, median=False)
    return s.select("chrom", (F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)).alias("middle"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


__all__ = ["chromgraph", "distribution", "sections_of", "summary", "whole"]
