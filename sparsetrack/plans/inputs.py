"""Signals, regions, masks and chains made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS, DAYS = 720, 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.col("pos").cast("long").alias("start"), (F.col("pos") + 1).cast("long").alias("end"), F.col("value").cast("double").alias("value"))


def _hours() -> "F.Column":
    return F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz))")


def events(spark: SparkSession, sf_dir: str, chrom: str = "event_type", what: str = "sum") -> DataFrame:
    """Hourly sums of value (or counts of rows), by event type or user."""
    value = F.sum(F.col("value").cast("decimal(18,2)")) if what == "sum" else F.count("*")
    e = table(spark, sf_dir, "events")
    return _runs(e.groupBy(F.col(chrom).cast("string").alias("chrom"), _hours().alias("pos")).agg(value.alias("value")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantities by return flag."""
    days = F.expr("datediff(cast(l_shipdate as date), DATE '1995-01-01')")
    return _runs(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chrom"), days.alias("pos")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("value")))


def sizes(signal: DataFrame, size: int) -> DataFrame:
    return signal.select("chrom").distinct().select("chrom", F.lit(size).cast("long").alias("size"))


def regions(spark: SparkSession, sf_dir: str, signal: DataFrame) -> DataFrame:
    """Nations laid on every chromosome; the last ones reach past its end."""
    n, c = table(spark, sf_dir, "nation"), signal.select("chrom").distinct()
    k = F.col("n_nationkey").cast("long")
    return n.crossJoin(c).select(  # 25 rows for each chromosome
        F.concat_ws(":", "chrom", k.cast("string")).alias("row_id"), "chrom", (k * 30).alias("start"), (k * 30 + 10 + k % 7).alias("end"), F.col("n_name").alias("name"), F.when(k % 2 == 1, "-").otherwise("+").alias("strand")
    )


def mask(spark: SparkSession, sf_dir: str, signal: DataFrame) -> DataFrame:
    k = F.col("r_regionkey").cast("long")
    return table(spark, sf_dir, "region").crossJoin(signal.select("chrom").distinct()).select("chrom", (k * 140).alias("start"), (k * 140 + 37).alias("end"))


def chain(spark: SparkSession, sf_dir: str, signal: DataFrame) -> DataFrame:
    k = F.col("r_regionkey").cast("long")
    t0, t1 = k * 140, k * 140 + F.when(k == 2, 150).otherwise(120)
    return table(spark, sf_dir, "region").crossJoin(signal.select("chrom").distinct()).select(
        F.concat_ws(":", "chrom", k.cast("string")).alias("chain_id"), F.col("chrom").alias("t_name"), t0.alias("t_start"), t1.alias("t_end"), F.col("chrom").alias("q_name"), (1000 + k * 50).alias("q_start"), F.lit(2000).cast("long").alias("q_size"), F.when(k % 2 == 1, "-").otherwise("+").alias("q_strand"), t0.alias("chain_t_start"), t1.alias("chain_t_end")
    )
