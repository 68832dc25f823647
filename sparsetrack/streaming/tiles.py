"""Running statistics of tiles for signals that arrive as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.intervals import cut_at


def stream_tiles(signal: DataFrame, width: int) -> DataFrame:
    """(chrom, start, end, num_data, min, max, mean) of tiles; works on streams (complete or update mode) and on tables.

    Runs are cut at tile bounds and weigh by their length.
    """
    rows = cut_at(signal.where("value is not null"), width)
    w = F.col("end") - F.col("start")
    out = rows.groupBy("chrom", (F.col("tile") * width).alias("start")).agg(F.sum(w).alias("num_data"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * w) / F.sum(w)).alias("mean"))
    return out.withColumn("end", F.col("start") + width)
