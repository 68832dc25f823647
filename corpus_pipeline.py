"""A corpus pipeline: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsetrack.llm import op1_toxicity, op3_suffix_dedup, op6_minmax_dedup, op8_decontaminate, op10_packing
from sparsetrack.llm.shared import fresh_dir

STAGES = [
    ("toxicity", op1_toxicity.stage),
    ("minhash_near_dedup", op6_minmax_dedup.stage),
    ("suffix_array_dedup", op3_suffix_dedup.stage),
    ("decontamination", op8_decontaminate.stage),
    ("packing", op10_packing.stage),
]

#: Toxicity and packing have no SQL form; tests/llm/test_stages.py holds the stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
