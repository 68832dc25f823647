"""Interval algebra on DataFrames of half-open, 0-based (chrom, start, end) rows.

Joins are dealt by (chrom, bin), never by chromosome alone, so one long chromosome is no hot key.  ``merge``, ``condense``
and ``depth`` cut intervals at tile bounds and work inside tiles; across them goes only what touches a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN, TILE, SMALL = 1 << 14, 1 << 20, 1 << 14


def sections_of(sizes: DataFrame) -> DataFrame:
    """(section_id, chrom, start, end): whole chromosomes, one section each; the id is the name's hash."""
    return sizes.select(F.xxhash64("chrom").alias("section_id"), "chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))


def overlaps(left: DataFrame, right: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Inner range join: all of ``left`` and, prefixed ``r_``, of ``right``; plus the common part ``o_start``, ``o_end``.

    A pair is made in the one bin that holds the start of its common part.  Empty intervals meet nothing.
    """
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).where("r_end > r_start")
    a = left.where("end > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    b = r.withColumn("r_bin", F.explode(F.sequence(F.floor(F.col("r_start") / bin_size), F.floor((F.col("r_end") - 1) / bin_size))))
    first = F.greatest("start", "r_start")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("bin") == F.col("r_bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.floor(first / bin_size) == F.col("bin"))
    return a.join(b, on).withColumn("o_start", first).withColumn("o_end", F.least("end", "r_end")).drop("bin", "r_bin")


def clip(signal: DataFrame, sections: DataFrame) -> DataFrame:
    """Signal runs inside sections, with ``section_id``."""
    return overlaps(signal, sections).select(F.col("r_section_id").alias("section_id"), "chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end"), "value")


def _join_touching(df: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Join rows that touch or overlap within ``keys`` and agree in ``same``."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = df.withColumn("new", new.cast("long")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*keys, *same, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def cut_at(intervals: DataFrame, tile: int) -> DataFrame:
    """Intervals cut at multiples of ``tile``, with their ``tile`` number."""
    each = intervals.where("end > start").withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    return each.withColumn("start", F.greatest("start", F.col("tile") * tile)).withColumn("end", F.least("end", (F.col("tile") + 1) * tile))


def merge(intervals: DataFrame, keys: tuple[str, ...] = ("chrom",), same: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """Maximal unions of touching or overlapping intervals with equal ``keys`` (and equal ``same``).

    Intervals are joined inside tiles; only those that touch a tile's bound are joined across, a few for each tile.
    """
    keys, same = list(keys), list(same)
    inner = _join_touching(cut_at(intervals.select(*keys, *same, "start", "end"), tile), [*keys, "tile"], same)
    bound = (F.col("start") % tile == 0) | (F.col("end") % tile == 0)
    across = _join_touching(inner.where(bound).drop("tile"), keys, same)
    return inner.where(~bound).drop("tile").unionByName(across).select(*keys, "start", "end", *same)


def depth(intervals: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, start, end, depth): stretches of one depth of cover, cut at tile bounds; nothing where there is no cover."""
    cut = cut_at(intervals.select("chrom", "start", "end"), tile)
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    events = cut.select("chrom", "tile", F.explode(ends).alias("x")).select("chrom", "tile", "x.pos", "x.d")
    w = Window.partitionBy("chrom", "tile").orderBy("pos")
    steps = events.groupBy("chrom", "tile", "pos").agg(F.sum("d").alias("d")).withColumn("depth", F.sum("d").over(w)).withColumn("end", F.lead("pos").over(w))
    return steps.where("depth > 0").select("chrom", F.col("pos").alias("start"), "end", "depth")


def condense(signal: DataFrame) -> DataFrame:
    """Touching runs of one value become one run (values are equal if their bits are)."""
    return merge(signal, same=("value",))


def intersect(signal: DataFrame, mask: DataFrame) -> DataFrame:
    """What of the signal lies in the mask."""
    return overlaps(signal, merge(mask)).select("chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end"), "value")


def gaps(start: Column, end: Column, cuts: Column) -> Column:
    """Array of (start, end) of an interval without the sorted, disjoint ``cuts``."""
    starts = F.concat(F.array(start), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(end))
    return F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda g: g["end"] > g["start"])


def subtract(signal: DataFrame, mask: DataFrame, tile: int = SMALL) -> DataFrame:
    """What of the signal lies outside the mask; runs are cut at tile bounds."""
    cuts = cut_at(_join_touching(cut_at(mask.select("chrom", "start", "end"), tile), ["chrom", "tile"], []), tile)
    cuts = cuts.groupBy("chrom", "tile").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    both = cut_at(signal.select("chrom", "start", "end", "value"), tile).join(cuts, ["chrom", "tile"], "left")
    mine = F.filter(F.coalesce("cuts", none), lambda c: (c["start"] < F.col("end")) & (c["end"] > F.col("start")))
    return both.select("chrom", F.explode(gaps(F.col("start"), F.col("end"), mine)).alias("g"), "value").select("chrom", "g.start", "g.end", "value")


def complement(signal: DataFrame, sections: DataFrame, tile: int = SMALL) -> DataFrame:
    """(section_id, chrom, start, end): the parts of sections without signal, cut at tile bounds."""
    return _gaps(signal, sections, tile).select("section_id", "chrom", "start", "end")


def _gaps(signal: DataFrame, sections: DataFrame, tile: int = SMALL) -> DataFrame:
    keys = ["section_id", "chrom", "s_start", "s_end", "start", "end"]
    tiles = cut_at(sections.select("section_id", "chrom", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "start", "end"), tile).select(*keys)
    met = overlaps(tiles, signal.select("chrom", "start", "end")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("o_start").alias("start"), F.col("o_end").alias("end")))).alias("cuts"))
    all_ = tiles.join(met, keys, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return all_.select(*keys[:4], F.explode(gaps(F.col("start"), F.col("end"), F.coalesce("cuts", none))).alias("g")).select(*keys[:4], "g.start", "g.end")


def cover(signal: DataFrame, sections: DataFrame, fill: float | None = None, tile: int = SMALL) -> DataFrame:
    """(section_id, chrom, s_start, s_end, start, end, value): all of the sections in runs, cut at tile bounds.

    Where there is no signal, runs have NULL or ``fill``.
    """
    runs = overlaps(signal, sections).select(F.col("r_section_id").alias("section_id"), "chrom", F.col("r_start").alias("s_start"), F.col("r_end").alias("s_end"), F.col("o_start").alias("start"), F.col("o_end").alias("end"), "value")
    rest = _gaps(signal, sections, tile).withColumn("value", F.lit(fill).cast("double"))
    return cut_at(runs, tile).drop("tile").unionByName(rest)


def bases(intervals: DataFrame, tile: int = SMALL) -> DataFrame:
    """A row for each base: ``pos`` in place of start and end.  Long intervals are cut first: no array holds more than a tile."""
    each = cut_at(intervals, tile).drop("tile")
    return each.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).drop("start", "end")


def dense(signal: DataFrame, sections: DataFrame, fill: float | None = None) -> DataFrame:
    """(section_id, chrom, s_start, s_end, pos, value) for every base of the sections; NULL (or ``fill``) where there is no signal."""
    return bases(cover(signal, sections, fill)).select("section_id", "chrom", "s_start", "s_end", "pos", "value")


def tiled(sections: DataFrame, width: int) -> DataFrame:
    """Sections cut every ``width`` bases from their starts; the last tile may be short."""
    return sections.where("end > start").select("section_id", "chrom", F.explode(F.sequence("start", F.col("end") - 1, F.lit(width).cast("long"))).alias("start"), "end").select("section_id", "chrom", "start", F.least(F.col("start") + width, "end").alias("end"))
