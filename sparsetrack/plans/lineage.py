"""Tables between the rounds of an iterative operator, in the folder that all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` and read it back: a lost executor costs one round at most.

    Where that isn't set, a temporary folder serves in local mode (tests); on a cluster it is an error.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparsetrack-")
        spark.conf.set("spark.checkpoint.dir", path)
    path = f"{path.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
