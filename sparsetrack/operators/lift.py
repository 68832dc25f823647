"""Moving a signal to other coordinates through chain blocks.

Blocks: chain_id, t_name, t_start, t_end, q_name, q_start, q_size, q_strand, chain_t_start, chain_t_end; block bases map
one to one, on a minus strand from the other end.  Runs are mapped as runs; what collides is found by depth of cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.intervals import bases, depth, overlaps, subtract


def _parts(signal: DataFrame, where: DataFrame) -> DataFrame:
    """Parts of runs in disjoint intervals."""
    return overlaps(signal, where).select("chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end"), "value")


def _mapped(single: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, start, end, value) at the destination, with t_chrom, t_start, t_end and strand of the source."""
    met = overlaps(single, blocks.withColumnsRenamed({"t_name": "chrom", "t_start": "start", "t_end": "end"}))
    a, b = (F.col("r_q_start") + F.col(c) - F.col("r_start") for c in ("o_start", "o_end"))
    minus = F.col("r_q_strand") == "-"
    start, end = F.when(minus, F.col("r_q_size") - b).otherwise(a), F.when(minus, F.col("r_q_size") - a).otherwise(b)
    return met.select(F.col("r_q_name").alias("chrom"), start.alias("start"), end.alias("end"), "value", F.col("chrom").alias("t_chrom"), F.col("o_start").alias("t_start"), F.col("o_end").alias("t_end"), F.col("r_q_strand").alias("strand"))


def _at_source(met: DataFrame) -> DataFrame:
    """Source bases of parts of mapped runs: (chrom, pos, q_name, q_pos)."""
    each = met.withColumn("q", F.explode(F.sequence("o_start", F.col("o_end") - 1)))
    pos = F.when(F.col("strand") == "-", F.col("t_end") - 1 - (F.col("q") - F.col("start"))).otherwise(F.col("t_start") + F.col("q") - F.col("start"))
    return each.select(F.col("t_chrom").alias("chrom"), pos.alias("pos"), F.col("chrom").alias("q_name"), F.col("q").alias("q_pos"))


def lift(signal: DataFrame, blocks: DataFrame, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The lifted signal (chrom, start, end, value) and what was left, base by base (chrom, pos, reason, q_name, q_pos).

    Reasons: deleted (no chain), duplicated (several chains), problem (a gap inside the chain), multi_mapped (several
    source bases for one destination, named by q_name and q_pos), off_end (outside ``sizes``).
    """
    chains = blocks.select("chain_id", F.col("t_name").alias("chrom"), F.col("chain_t_start").alias("start"), F.col("chain_t_end").alias("end")).distinct()
    met = depth(chains)
    single = _parts(signal, met.where("depth = 1"))
    mapped = _mapped(single, blocks)
    alone, crowded = (overlaps(mapped, depth(mapped).where(f"depth {x}").select("chrom", "start", "end")) for x in ("= 1", "> 1"))
    late = _at_source(crowded).withColumn("reason", F.lit("multi_mapped"))
    if sizes is not None:
        alone = alone.join(sizes.select("chrom", F.coalesce("size", F.lit(0)).alias("limit")), "chrom", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))
        outside = alone.withColumn("o_start", F.greatest("o_start", "limit")).where("o_end > o_start").drop("limit")
        late = late.unionByName(_at_source(outside).withColumn("reason", F.lit("off_end")))
        alone = alone.withColumn("o_end", F.least("o_end", "limit")).where("o_end > o_start")
    lifted = alone.select("chrom", F.col("o_start").alias("start"), F.col("o_end").alias("end"), "value")
    in_blocks = blocks.select(F.col("t_name").alias("chrom"), F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    early = None
    for reason, rows in (("deleted", subtract(signal, met)), ("duplicated", _parts(signal, met.where("depth > 1"))), ("problem", subtract(single, in_blocks))):
        part = bases(rows).select("chrom", "pos", F.lit(reason).alias("reason"))
        early = part if early is None else early.unionByName(part)
    return lifted, early.unionByName(late, allowMissingColumns=True)
