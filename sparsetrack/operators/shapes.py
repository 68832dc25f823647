"""Local extrema, symbolic words, chunks and random regions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..plans.intervals import SMALL, TILE, clip, condense, cut_at, merge, overlaps, subtract
from ..plans.lineage import cut
from .summaries import whole

#: Letters of the alphabets of 4 and 8 symbols; others take A, B, C and so on.
LETTERS = {4: "ACGT", 8: "ACGTVLIM"}


def local_extrema(signal: DataFrame, min_sep: int = 0, kind: str | None = None, against: DataFrame | None = None, shift: int = 0) -> DataFrame:
    """(chrom, pos, value, strand): plateaus above (+) or below (-) both neighbours, at their first base.

    Ends of gap-free stretches are none.  ``min_sep`` keeps the highest (lowest) and drops what is nearer to it, ties to the
    left; ``against`` adds the nearest extremum of the same kind in another signal within ``shift`` bases.
    """
    if kind not in (None, "maxima", "minima"):
        raise ValueError("kind is maxima or minima")
    # a neighbour touches, so it is found by its end or start
    flat = condense(signal)
    before, after = flat.select("chrom", F.col("end").alias("start"), F.col("value").alias("b")), flat.select("chrom", F.col("start").alias("end"), F.col("value").alias("a"))
    flat = flat.join(before, ["chrom", "start"]).join(after, ["chrom", "end"])
    strand = F.when((F.col("value") > F.col("b")) & (F.col("value") > F.col("a")), "+").when((F.col("value") < F.col("b")) & (F.col("value") < F.col("a")), "-")
    out = flat.withColumn("strand", strand).where("strand is not null").select("chrom", F.col("start").alias("pos"), "value", "strand")
    if kind:
        out = out.where(F.col("strand") == ("+" if kind == "maxima" else "-"))
    if min_sep > 0:
        out = kept_apart(out, min_sep)
    if against is not None:
        other = local_extrema(against, kind=kind).select("chrom", (F.col("pos") - shift).alias("start"), (F.col("pos") + shift + 1).alias("end"), F.col("pos").alias("other_pos"), "strand")
        met = overlaps(out.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1), other).where("strand = r_strand")
        n = F.row_number().over(Window.partitionBy("chrom", "pos", "strand").orderBy(F.abs(F.col("r_other_pos") - F.col("pos")), "r_other_pos"))
        near = met.withColumn("n", n).where("n = 1").select("chrom", "pos", "strand", F.col("r_other_pos").alias("against_pos"))
        out = out.join(near, ["chrom", "pos", "strand"])
    return out


def local_winners(points: DataFrame, min_sep: int) -> DataFrame:
    """One round over (chrom, strand, pos, value, kept): undecided points with nothing better undecided within reach are kept,
    and what is within their reach goes.  Tiles with a halo of twice the reach make it the same however long a cluster is."""
    near, tile = min_sep - 1, max(1 << 16, 8 * min_sep)
    each = points.withColumn("tile", F.explode(F.sequence(F.floor((F.col("pos") - 2 * near) / tile), F.floor((F.col("pos") + 2 * near) / tile))))
    w = Window.partitionBy("chrom", "strand", "tile").orderBy("pos").rangeBetween(-near, near)
    score = F.when(F.col("strand") == "+", F.col("value")).otherwise(-F.col("value"))
    mine = F.struct(score.alias("score"), (-F.col("pos")).alias("at"))
    each = each.withColumn("best", F.max(F.when(~F.col("kept"), mine)).over(w))
    each = each.withColumn("wins", ~F.col("kept") & (F.col("best.at") == -F.col("pos")))
    each = each.withColumn("near", F.max("wins").over(w)).where(F.floor(F.col("pos") / tile) == F.col("tile"))
    return each.where(F.col("kept") | F.col("wins") | ~F.col("near")).select("chrom", "strand", "pos", "value", (F.col("kept") | F.col("wins")).alias("kept"))


def kept_apart(points: DataFrame, min_sep: int, rounds: int = 3) -> DataFrame:
    """Of (chrom, strand, pos, value) the best, then the best of those at least ``min_sep`` from it, and so on.

    Some rounds of local winners decide nearly all; what they leave is in small clusters, each worked on by itself.
    """
    state = points.select("chrom", "strand", "pos", "value", F.lit(False).alias("kept"))
    for _ in range(rounds):
        state = local_winners(state, min_sep)
    state = state.persist(StorageLevel.DISK_ONLY)  # read four times; made anew where an executor is lost
    left = state.where(~F.col("kept")).drop("kept")
    # points farther apart than that are independent
    reach = merge(left.select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + min_sep).alias("end")), ("chrom", "strand"))
    clusters = overlaps(left.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1), reach).where("strand = r_strand").select("chrom", "pos", "value", "strand", F.col("r_start").alias("cluster"))
    late = clusters.groupBy("chrom", "strand", "cluster").applyInPandas(_apart(min_sep), "chrom string, pos long, value double, strand string")
    return state.where("kept").select("chrom", "pos", "value", "strand").unionByName(late)


def _apart(min_sep: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        pos, value = rows["pos"].to_numpy(), rows["value"].to_numpy() * (-1 if rows["strand"].iloc[0] == "+" else 1)
        free, keep = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        first, last = np.searchsorted(pos, pos - min_sep, "right"), np.searchsorted(pos, pos + min_sep, "left")
        for i in np.lexsort((pos, value)).tolist():
            if free[i]:
                keep[i] = True
                free[first[i] : last[i]] = False
        return rows.loc[keep, ["chrom", "pos", "value", "strand"]]

    return run


def sax(signal: DataFrame, k: int, mean: float | None = None, std: float | None = None) -> DataFrame:
    """(chrom, start, end, value, bin, letter) of each run: its z-value's place among k equally likely normal intervals.

    Without ``mean`` and ``std`` those of the whole signal (sample deviation) are taken.
    """
    if (mean is None) != (std is None) or (std is not None and std <= 0):
        raise ValueError("mean and a positive std go together")
    breaks = [NormalDist().inv_cdf(i / k) for i in range(1, k)]
    if mean is None:
        facts = whole(signal).select(F.col("mean").alias("m"), F.col("std").alias("sd"))
        rows = signal.crossJoin(F.broadcast(facts))  # one row
    else:
        rows = signal.withColumn("m", F.lit(float(mean))).withColumn("sd", F.lit(float(std)))
    z = (F.col("value") - F.col("m")) / F.col("sd")
    bin_ = sum((F.when(z >= b, 1).otherwise(0) for b in breaks), F.lit(0))
    letters = LETTERS.get(k, "".join(chr(65 + i) for i in range(k)))
    return rows.withColumn("bin", bin_).select("chrom", "start", "end", "value", "bin", F.substring(F.lit(letters), F.col("bin") + 1, F.lit(1)).alias("letter"))


def sax_words(signal: DataFrame, sections: DataFrame, k: int, mean: float | None = None, std: float | None = None, window: int = 1) -> DataFrame:
    """(chrom, start, end, word): one word for each gap-free stretch.

    With a ``window`` of more than one base a letter stands for the mean of so many, from the stretch's start; the last may be short.
    """
    if window < 1:
        raise ValueError("a window has at least one base")
    runs = merge(clip(signal, sections), ("section_id", "chrom")).withColumnsRenamed({"start": "s", "end": "e"}).withColumn("start", F.col("s")).withColumn("end", F.col("e"))
    if window == 1:
        letters = overlaps(runs, sax(signal, k, mean, std)).select("chrom", "s", "e", F.col("o_start").alias("at"), F.repeat("r_letter", (F.col("o_end") - F.col("o_start")).cast("int")).alias("x"))
    else:
        if mean is None and std is None:  # those of the bases, not of their means
            mean, std = whole(signal).select("mean", "std").first()
            if std is None or std <= 0:
                raise ValueError("a signal without deviation has no symbols")
        met = overlaps(runs, signal.select("chrom", "start", "end", "value"))
        place = lambda c: F.floor((c - F.col("s")) / window)
        each = met.withColumn("at", F.explode(F.sequence(place(F.col("o_start")), place(F.col("o_end") - 1))))
        first = F.col("s") + F.col("at") * window
        w = F.least("o_end", first + window) - F.greatest("o_start", first)
        means = each.withColumn("w", w).groupBy("chrom", "s", "e", "at").agg((F.sum(F.col("r_value") * F.col("w")) / F.sum("w")).alias("value"))
        whose = F.struct("chrom", "s", "e").alias("chrom")  # carried through as one column
        letters = sax(means.select(whose, F.col("at").alias("start"), (F.col("at") + 1).alias("end"), "value"), k, mean, std).select("chrom.*", F.col("start").alias("at"), F.col("letter").alias("x"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]), "")
    return letters.groupBy("chrom", F.col("s").alias("start"), F.col("e").alias("end")).agg(word.alias("word"))


def _within(rows: pd.DataFrame) -> tuple[list[int], list[int], list[int]]:
    """A tile's beginnings in order, their successors (-1: none), and these by row number (the number of rows: not in this tile)."""
    rows = rows.sort_values("a")
    a, then = rows["a"].to_numpy(), rows["next"].to_numpy()
    return a.tolist(), then.tolist(), np.where(then < 0, len(a), np.searchsorted(a, then)).tolist()


def _leave(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, next): the first beginning in another tile that ``a`` leads to."""
    a, leads, at = _within(rows)
    for i in range(len(a) - 1, -1, -1):
        if at[i] < len(a):
            leads[i] = leads[at[i]]
    return pd.DataFrame({"a": a, "next": leads})


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """(a): the beginnings in a tile that ``entry`` leads to, itself included."""
    a, _, at = _within(rows)
    met, i = [], a.index(rows["entry"].iloc[0])
    while i < len(a):
        met.append(a[i])
        i = at[i]
    return pd.DataFrame({"a": met})


def split_chunks(signal: DataFrame, size: int, min_gap: int = 1, tile: int = TILE) -> DataFrame:
    """(chunk, chrom, start, end): gap-free stretches gathered greedily, in order, into chunks of about ``size`` bases.

    A chunk ends where the next stretch would overfill it after a gap of at least ``min_gap``, or where another chromosome
    begins that doesn't fit in.  Chromosomes, from their first stretch to their last, are laid end to end on one axis; then
    what a chunk holds is a difference of places, and where the next one begins depends on where it began alone.  Each
    stretch that may begin a chunk looks up its successor in tiles of the axis; a tile's are followed to where they leave it,
    what is reached from the first stretch is found by pointers from tile to tile that double each round, and then followed
    inside.  A task has at most a tile's stretches; single windows see a row for each chromosome or tile.
    """
    runs = merge(signal).select("chrom", "start", "end")
    spans = runs.groupBy("chrom").agg(F.min("start").alias("from"), (F.max("end") - F.min("start")).alias("span"))
    spans = spans.select("chrom", "from", (F.sum("span").over(Window.orderBy("chrom")) - F.col("span")).alias("before"))
    place = lambda c: F.col("before") + F.col(c) - F.col("from")
    laid = runs.join(spans, "chrom").select("chrom", "start", "end", place("start").alias("a"), place("end").alias("e"), (F.col("start") == F.col("from")).alias("begins"))
    laid = cut(laid.withColumn("tile", F.floor(F.col("a") / tile)))
    w = Window.partitionBy("tile").orderBy("a")
    last = laid.groupBy("tile").agg(F.max("e").alias("e")).select("tile", F.lag("e").over(Window.orderBy("tile")).alias("last"))
    gap = F.col("a") - F.coalesce(F.lag("e").over(w), F.col("last"))
    may = laid.join(last, "tile").withColumn("gap", gap).where(F.col("begins") | (F.col("gap") >= min_gap)).select("a", "e")
    # the first stretch that may begin a chunk and ends beyond what the chunk begun at ``a`` can hold
    ends, asks = F.struct(F.col("e").alias("at"), F.lit(0).alias("ask"), "a"), F.struct(F.greatest(F.col("a") + size, "e").alias("at"), F.lit(1).alias("ask"), "a")
    rows = may.select(F.explode(F.array(ends, asks)).alias("x")).select("x.*").withColumn("tile", F.floor(F.col("at") / tile))
    found = F.when(F.col("ask") == 0, F.col("a"))
    nearest = F.last(found, ignorenulls=True).over(Window.partitionBy("tile").orderBy(F.desc("at"), F.desc("ask")))
    later = rows.groupBy("tile").agg(F.min_by(found, F.when(F.col("ask") == 0, F.col("at"))).alias("first"))
    later = later.select("tile", F.last("first", ignorenulls=True).over(Window.orderBy(F.desc("tile")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    jump = rows.withColumn("nearest", nearest).where("ask = 1").join(later, "tile").select("a", F.coalesce("nearest", "later", F.lit(-1)).alias("next"))
    jump = cut(jump.withColumn("tile", F.floor(F.col("a") / tile)))
    # what a chunk's beginning leads to in another tile; of these, those reached from the first stretch, by doubling pointers
    leaves = cut(jump.groupBy("tile").applyInPandas(_leave, "a long, next long"))
    entries, many = cut(laid.agg(F.min("a").alias("a")).where("a is not null")), 0
    leap = leaves.join(leaves.where("next >= 0").select(F.col("next").alias("a")).union(entries).distinct(), "a", "left_semi").where("next >= 0")
    while (now := entries.count()) > many:
        leap, many = cut(leap), now
        entries = cut(entries.union(entries.join(leap, "a").select("next")).distinct())
        leap = leap.join(leap.select(F.col("a").alias("next"), F.col("next").alias("far")), "next").select("a", F.col("far").alias("next"))
    # a tile is entered at most once; in it the pointers are followed from there
    entered = entries.select(F.floor(F.col("a") / tile).alias("tile"), F.col("a").alias("entry"))
    begun = jump.join(entered, "tile").groupBy("tile").applyInPandas(_follow, "a long")
    # numbers of chunks: beginnings so far, in the tiles before and in the tile
    marked = laid.join(begun.withColumn("new", F.lit(1)), "a", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    many_before = marked.groupBy("tile").agg(F.sum("new").alias("n")).select("tile", (F.sum("n").over(Window.orderBy("tile")) - F.col("n")).alias("n"))
    numbered = marked.withColumn("k", F.sum("new").over(w)).join(many_before, "tile").withColumn("chunk", F.col("n") + F.col("k") - 1)
    return numbered.groupBy("chunk", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def random_places(signal: DataFrame, sections: DataFrame, size: int, max_na: float = 0.4, blacklist: DataFrame | None = None, tile: int = SMALL) -> DataFrame:
    """(chrom, tile, start, end): disjoint stretches of places where a region of ``size`` bases may start, cut at tile bounds.

    Such a region lies in its section, has at most the share ``max_na`` of its bases without data, and meets nothing of the blacklist.
    What a window covers grows by one a base, stays or falls by one between the places where its start or end meets the bound
    of a run; so places are found from bounds alone, tile by tile, from the cover at the tile's start.
    """
    need = size - math.floor(max_na * size)  # bases with data
    data = merge(signal.select("chrom", "start", "end"))
    room = merge(sections.select("chrom", "start", (F.col("end") - size + 1).alias("end")).where("end > start"))
    room = cut_at(room, tile).select("chrom", "tile", F.col("start").alias("a"), F.col("end").alias("b"))
    # at the first place of each tile: what its window covers, and whether the cover is about to grow or fall
    met = overlaps(room.select("chrom", "tile", "a", F.col("a").alias("start"), (F.col("a") + size + 1).alias("end")), data)
    lo, hi = F.greatest("r_start", "a"), F.least("r_end", F.col("a") + size)
    begins, ends = (F.col("r_start") <= F.col("a")).cast("long"), (F.col("r_end") > F.col("a") + size).cast("long")
    at_first = met.groupBy("chrom", "tile", "a").agg(F.sum(F.greatest(hi - lo, F.lit(0))).alias("have"), F.sum(ends - begins).alias("slope"))
    first = room.join(at_first, ["chrom", "tile", "a"], "left").select("chrom", "tile", "a", "b", F.col("a").alias("p"), F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("slope", F.lit(0)).alias("turn"))
    turns = F.array(*(F.struct((F.col(c) - d).alias("p"), F.lit(t).alias("turn")) for c, d, t in (("start", size, 1), ("end", size, -1), ("start", 0, -1), ("end", 0, 1))))
    bends = data.select("chrom", F.explode(turns).alias("x")).select("chrom", F.col("x.p").alias("start"), (F.col("x.p") + 1).alias("end"), "x.turn")
    inner = overlaps(bends, room.select("chrom", "tile", "a", "b", F.col("a").alias("start"), F.col("b").alias("end"))).where("start > r_a")
    inner = inner.select("chrom", F.col("r_tile").alias("tile"), F.col("r_a").alias("a"), F.col("r_b").alias("b"), F.col("start").alias("p"), F.lit(0).cast("long").alias("have"), F.col("turn").cast("long").alias("turn"))
    steps = first.unionByName(inner).groupBy("chrom", "tile", "a", "b", "p").agg(F.sum("have").alias("have"), F.sum("turn").alias("turn"))
    w = Window.partitionBy("chrom", "tile", "a", "b").orderBy("p")
    steps = steps.withColumn("slope", F.sum("turn").over(w)).withColumn("next", F.coalesce(F.lead("p").over(w), F.col("b")))
    gain = F.col("slope") * (F.col("next") - F.col("p"))
    steps = steps.withColumn("now", F.sum(F.col("have") + gain).over(w) - gain)
    short = need - F.col("now")  # bases with data that the first window of the step lacks
    good = steps.select(
        "chrom",
        "tile",
        F.when(F.col("slope") > 0, F.greatest(F.col("p"), F.col("p") + short)).otherwise(F.col("p")).alias("start"),
        F.when((F.col("slope") < 0) & (short <= 0), F.least(F.col("next"), F.col("p") - short + 1)).when((F.col("slope") <= 0) & (short > 0), F.col("p")).otherwise(F.col("next")).alias("end"),
    ).where("end > start")
    if blacklist is not None:
        barred = blacklist.where("end > start").select("chrom", (F.col("start") - size + 1).alias("start"), "end")
        good = subtract(good.select("chrom", "start", "end", F.lit(0.0).alias("value")), barred, tile)
        good = good.select("chrom", F.floor(F.col("start") / tile).alias("tile"), "start", "end")
    return good


def random_regions(signal: DataFrame, sections: DataFrame, n: int, size: int, max_na: float = 0.4, blacklist: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """``n`` different random regions of ``size`` bases with at most the share ``max_na`` without data, off the blacklist.

    They are drawn by inverse cumulative length from all places where one may start, each as likely as any other; an error, if
    there are fewer than ``n``, but none where nothing can be drawn from.  Draws come from hashes, so a lost task draws the same again.
    """
    places = random_places(signal, sections, size, max_na, blacklist).persist(StorageLevel.DISK_ONLY)  # read four times
    # cumulative over chromosomes, over tiles within one, over stretches within a tile
    length = F.col("end") - F.col("start")
    tiles = places.groupBy("chrom", "tile").agg(F.sum(length).alias("many"))
    chroms = tiles.groupBy("chrom").agg(F.sum("many").alias("many"))
    total = chroms.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    if 0 < total < n:
        raise ValueError(f"{n} regions asked for, but only {total} places hold one")
    before = lambda of, w: F.sum(of).over(w) - of
    chroms = chroms.select("chrom", before(F.col("many"), Window.orderBy("chrom")).alias("c"))  # a row for each chromosome
    tiles = tiles.select("chrom", "tile", before(F.col("many"), Window.partitionBy("chrom").orderBy("tile")).alias("t"))
    own = places.withColumn("o", before(length, Window.partitionBy("chrom", "tile").orderBy("start")))
    axis = own.join(tiles, ["chrom", "tile"]).join(chroms, "chrom").select("chrom", F.col("start").alias("from"), (F.col("c") + F.col("t") + F.col("o")).alias("start"), length.alias("many"))
    axis = axis.select(F.lit("").alias("chrom"), F.col("chrom").alias("on"), "from", "start", (F.col("start") + F.col("many")).alias("end"))
    spark = signal.sparkSession
    if 2 * n >= total:  # every place, in an order of its own
        draws = spark.range(total).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    else:
        tries = n
        while True:
            draws = spark.range(tries).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("place"), "id").groupBy("place").agg(F.min("id").alias("id"))
            if draws.count() >= n:
                break
            tries += n
        draws = draws.orderBy("id").limit(n).select(F.col("place").alias("id"))
    points = draws.select(F.lit("").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    at = F.col("r_from") + F.col("start") - F.col("r_start")
    return overlaps(points, axis).select(F.col("r_on").alias("chrom"), at.alias("start"), (at + size).alias("end"))
