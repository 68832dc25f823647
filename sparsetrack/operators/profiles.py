"""Signals around regions: aggregate profiles, matrices, extracts, maxima, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import offset_in, position_label, recentred
from ..plans.intervals import bases, overlaps


def centred(regions: DataFrame, left: int, right: int, anchor: str = "centre", firstbase: bool = False) -> DataFrame:
    """Regions with the window around their anchor as start and end; a missing strand counts as plus."""
    strand = F.col("strand") if "strand" in regions.columns else F.lit("+")
    a, b = recentred(F.col("start"), F.col("end"), strand, left, right, anchor, firstbase)
    return regions.withColumn("strand", F.coalesce(strand, F.lit("+"))).withColumn("n_start", a).withColumn("n_end", b).drop("start", "end").withColumnsRenamed({"n_start": "start", "n_end": "end"})


def covered(windows: DataFrame, signal: DataFrame) -> DataFrame:
    """(the windows' columns, offset, value) for each base of a window with data."""
    met = overlaps(windows, signal.select("chrom", "start", "end", "value"))
    each = met.withColumn("pos", F.explode(F.sequence(F.col("o_start"), F.col("o_end") - 1)))
    return each.select(*windows.columns, offset_in(F.col("pos"), F.col("start"), F.col("end"), F.col("strand")).alias("offset"), F.col("r_value").alias("value"))


def _all_signals(windows: DataFrame, signals: dict[str, DataFrame], fill: float | None) -> DataFrame:
    """Every base of every window for every signal, or only those with data if nothing fills the others."""
    out = None
    for name, signal in signals.items():
        part = covered(windows, signal)
        if fill is not None:
            grid = bases(windows.withColumn("w0", F.col("start")).withColumn("w1", F.col("end")))
            grid = grid.withColumnsRenamed({"w0": "start", "w1": "end"}).withColumn("offset", offset_in(F.col("pos"), F.col("start"), F.col("end"), F.col("strand"))).drop("pos")
            part = grid.join(part.select("row_id", "offset", "value"), ["row_id", "offset"], "left").withColumn("value", F.coalesce("value", F.lit(float(fill)))).select(*windows.columns, "offset", "value")
        part = part.withColumn("signal", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def aggregate(regions: dict[str, DataFrame], signals: dict[str, DataFrame], left: int, right: int, anchor: str = "centre", firstbase: bool = False, expanded: bool = False, fill: float | None = None) -> DataFrame:
    """(region_set, signal, position, mean, ...) over all regions of a set; positions without data have NULL statistics.

    ``expanded`` adds median, sd (of the sample), n, sum_squares, se, low (mean - se) and high (mean + se).
    Regions need a ``row_id``; pairs of sets and signals are all made (the catalogue of inputs is small).
    """
    windows = None
    for name, r in regions.items():
        part = centred(r, left, right, anchor, firstbase).select("row_id", "chrom", "start", "end", "strand").withColumn("region_set", F.lit(name))
        windows = part if windows is None else windows.unionByName(part)
    return _by_position(_all_signals(windows, signals, fill), regions, signals, left, left + right + bool(firstbase), firstbase, expanded)


def _by_position(rows: DataFrame, regions: dict[str, DataFrame], signals: dict[str, DataFrame], left: int, width: int, firstbase: bool, expanded: bool) -> DataFrame:
    """Statistics of (region_set, signal, offset, value) rows for every set, signal and position."""
    v = F.col("value")
    wanted = [F.avg(v).alias("mean")]
    if expanded:
        wanted += [F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"), (F.var_pop(v) * F.count(v)).alias("sum_squares")]
    got = rows.groupBy("region_set", "signal", position_label(F.col("offset"), left, firstbase).alias("position")).agg(*wanted)
    spark = rows.sparkSession
    grid = spark.createDataFrame([(r, s) for r in regions for s in signals], "region_set string, signal string").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    grid = grid.select("region_set", "signal", position_label(F.col("o"), left, firstbase).alias("position"))
    out = grid.join(got, ["region_set", "signal", "position"], "left")
    if expanded:
        se = F.col("sd") / F.sqrt("n")
        out = out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("se", F.when(F.col("n") > 1, se)).withColumn("low", F.col("mean") - F.col("se")).withColumn("high", F.col("mean") + F.col("se"))
    return out


def mean_length(regions: DataFrame) -> int:
    """The integer mean length of regions, for a body's width."""
    r = regions.agg(F.expr("sum(end - start) div count(*)").alias("m")).first()
    return int(r["m"] or 0)


def meta_windows(regions: DataFrame, left: int, meta: int, right: int) -> list[tuple[DataFrame, int, int]]:
    """The three parts of a stretched profile: windows, first column and width (0: a body stretched to ``meta`` columns)."""
    flank = centred(regions, left, 0, "starts"), centred(regions, 0, right, "ends")
    body = regions.withColumn("strand", F.coalesce(F.col("strand") if "strand" in regions.columns else F.lit("+"), F.lit("+")))
    return [(flank[0], 0, left), (body, left, 0), (flank[1], left + meta, right)]


def meta_vectors(regions: DataFrame, signal: DataFrame, left: int, meta: int, right: int) -> DataFrame:
    """(row_id, offset, value): left flank of starts, body stretched to ``meta`` columns, right flank of ends.

    A body column is the mean of the bases whose place, scaled by meta / length, falls into it; a body shorter than ``meta``
    repeats bases.
    """
    parts = []
    for windows, first, width in meta_windows(regions, left, meta, right):
        rows = covered(windows.select("row_id", "chrom", "start", "end", "strand"), signal)
        if width:
            parts.append(rows.select("row_id", (F.col("offset") + first).alias("offset"), "value"))
        else:
            length = F.col("end") - F.col("start")
            lo = F.floor(F.col("offset") * meta / length)
            hi = F.greatest(lo, F.ceil((F.col("offset") + 1) * meta / length) - 1)
            columns = F.when(length >= meta, F.array(lo)).otherwise(F.sequence(lo, hi))
            each = rows.select("row_id", F.explode(columns).alias("c"), "value").where(F.col("c") < meta)
            parts.append(each.groupBy("row_id", "c").agg(F.avg("value").alias("value")).select("row_id", (F.col("c") + first).alias("offset"), "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def aggregate_meta(regions: dict[str, DataFrame], signals: dict[str, DataFrame], left: int, meta: int, right: int, expanded: bool = False, fill: float | None = None) -> DataFrame:
    """As ``aggregate``, for stretched profiles; positions are -left .. -1, 1 .. meta + right."""
    rows = None
    for r, bed in regions.items():
        for s, signal in signals.items():
            part = meta_vectors(bed, signal, left, meta, right)
            if fill is not None:
                grid = bed.select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left + meta + right - 1).cast("long"))).alias("offset"))
                part = grid.join(part, ["row_id", "offset"], "left").withColumn("value", F.coalesce("value", F.lit(float(fill))))
            part = part.select("offset", "value", F.lit(r).alias("region_set"), F.lit(s).alias("signal"))
            rows = part if rows is None else rows.unionByName(part)
    return _by_position(rows, regions, signals, left, left + meta + right, False, expanded)


def matrix_meta(regions: DataFrame, signals: dict[str, DataFrame], left: int, meta: int, right: int) -> DataFrame:
    """As ``matrix``, for stretched profiles."""
    cells = None
    for i, signal in enumerate(signals.values()):
        part = meta_vectors(regions, signal, left, meta, right).withColumn("s", F.lit(i))
        cells = part if cells is None else cells.unionByName(part)
    strand = F.col("strand") if "strand" in regions.columns else F.lit("+")
    grid = regions.select("row_id", "chrom", "start", "end", F.coalesce(strand, F.lit("+")).alias("strand"), F.explode(F.sequence(F.lit(0), F.lit(len(signals) - 1))).alias("s")).withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left + meta + right - 1).cast("long"))))
    packed = F.array_sort(F.collect_list(F.struct("s", "offset", "value")))
    return grid.join(cells, ["row_id", "s", "offset"], "left").groupBy("row_id", "chrom", "start", "end", "strand").agg(F.transform(packed, lambda x: x["value"]).alias("values"))


def matrix_long(regions: DataFrame, signals: dict[str, DataFrame], left: int, right: int, anchor: str = "centre", tile: int = 1, fill: float | None = None) -> DataFrame:
    """(row_id, chrom, start, end, strand, signal, position, value), a row for every region, signal and column.

    ``tile`` averages that many neighbouring bases, ignoring gaps; it must divide both sides.
    """
    if tile > 1 and (left % tile or right % tile):
        raise ValueError("the tile must divide both sides of the window")
    windows = centred(regions, left, right, anchor).select("row_id", "chrom", "start", "end", "strand")
    cells = _all_signals(windows, signals, fill).groupBy("row_id", "signal", F.floor(F.col("offset") / tile).alias("c")).agg(F.avg("value").alias("value"))
    names = F.explode(F.array(*map(F.lit, signals)))
    grid = windows.withColumn("signal", names).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((left + right) // tile - 1).cast("long"))))
    p = F.col("c") * tile - left
    position = F.when(p >= 0, p + tile).otherwise(p) if tile > 1 else F.when(p >= 0, p + 1).otherwise(p)
    return grid.join(cells, ["row_id", "signal", "c"], "left").select("row_id", "chrom", "start", "end", "strand", "signal", position.alias("position"), "value")


def matrix(regions: DataFrame, signals: dict[str, DataFrame], left: int, right: int, anchor: str = "centre", tile: int = 1, fill: float | None = None) -> DataFrame:
    """(row_id, chrom, start, end, strand, values): the signals' vectors side by side, in the given order; gaps are NULL."""
    cells = matrix_long(regions, signals, left, right, anchor, tile, fill)
    order = F.create_map(*(x for i, n in enumerate(signals) for x in (F.lit(n), F.lit(i))))
    packed = F.array_sort(F.collect_list(F.struct(order[F.col("signal")].alias("s"), F.col("position").alias("p"), F.col("value").alias("v"))))
    return cells.groupBy("row_id", "chrom", "start", "end", "strand").agg(F.transform(packed, lambda x: x["v"]).alias("values"))


def fuse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two matrices of the same regions, side by side."""
    return a.join(b.select("row_id", F.col("values").alias("more")), "row_id").withColumn("values", F.concat("values", "more")).drop("more")


def cluster(vectors: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, list]:
    """k-means of vectors without gaps: (all columns, label, distance) and the centres; rows with gaps have NULL labels."""
    if not 2 <= k <= 10:
        raise ValueError("between 2 and 10 clusters")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sound = vectors.where(~F.exists("values", lambda x: x.isNull())).withColumn("features", array_to_vector("values"))
    model = KMeans(k=k, seed=seed, predictionCol="label").fit(sound)
    centres = [c.tolist() for c in model.clusterCenters()]
    of = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("label") + 1)
    apart = F.sqrt(F.aggregate(F.zip_with("values", of, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    labelled = model.transform(sound).withColumn("distance", apart).drop("features")
    return labelled.unionByName(vectors.where(F.exists("values", lambda x: x.isNull())), allowMissingColumns=True), centres


def extract(signal: DataFrame, regions: DataFrame, fill: float | None = None) -> DataFrame:
    """All columns of the regions, length and values (one for each base, reversed on the minus strand)."""
    windows = regions.withColumn("strand", F.coalesce(F.col("strand") if "strand" in regions.columns else F.lit("+"), F.lit("+"))).select("row_id", "chrom", "start", "end", "strand")
    got = covered(windows, signal).select("row_id", "offset", "value")
    grid = windows.where("end > start").select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("start") - 1)).alias("offset"))
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(float(fill)))
    packed = F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), value.alias("v"))))
    vectors = grid.join(got, ["row_id", "offset"], "left").groupBy("row_id").agg(F.transform(packed, lambda x: x["v"]).alias("values"))
    return regions.join(vectors, "row_id", "left").withColumn("length", F.col("end") - F.col("start"))


def extract_lines(signal: DataFrame, regions: DataFrame, locus_name: bool = False, fill: float | None = None) -> DataFrame:
    """(row_id, name, idx, value): extracts base by base; the name is the locus, or the region's own name or number."""
    own = F.when(F.col("name").isNull() | (F.col("name") == "."), F.concat(F.lit("region_"), F.col("row_id").cast("string"))).otherwise(F.col("name")) if "name" in regions.columns else F.concat(F.lit("region_"), F.col("row_id").cast("string"))
    name = F.concat("chrom", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string")) if locus_name else own
    return extract(signal, regions, fill).select("row_id", name.alias("name"), F.posexplode("values").alias("idx", "value"))


def maxima(signal: DataFrame, regions: DataFrame, median_base: bool = False) -> DataFrame:
    """(the regions' columns, maximum, offsets): where in each region the signal is largest; regions without data are left out.

    ``median_base``: only the median of these places (the mean of the middle two, cut to an integer).
    """
    met = overlaps(regions, signal.select("chrom", "start", "end", "value"))
    top = met.groupBy("row_id").agg(F.max("r_value").alias("maximum"))
    at = met.join(top, "row_id").where(F.col("r_value") == F.col("maximum")).select("row_id", "maximum", F.explode(F.sequence(F.col("o_start") - F.col("start"), F.col("o_end") - F.col("start") - 1)).alias("offset"))
    if median_base:
        offsets: Column = F.array(F.floor(F.percentile("offset", F.lit(0.5))))
    else:
        offsets = F.sort_array(F.collect_list("offset"))
    return regions.join(at.groupBy("row_id", "maximum").agg(offsets.alias("offsets")), "row_id")
