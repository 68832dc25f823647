"""What the text operators share: document keys, written tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only in local mode (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparsetrack-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back; a lost executor loses nothing of it."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Whole texts go to Python workers at most so many at a time: bounds what a task holds on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: What workers keep from task to task: functions that drop it.
_kept: list[Callable[[], None]] = []
_step = ""


def kept(drop: Callable[[], None]) -> None:
    _kept.append(drop)


def enter(step: str) -> None:
    """A worker that turns to another step drops what the one before kept."""
    global _step
    if step != _step:
        for drop in _kept:
            drop()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _step = step


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no DataFrame still to be run reads."""
    for t in tables:
        for file in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished, unreferenced steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, did, th, text, *more): null texts are empty; ``did`` is doc_id with null as the smallest long.

    ``th`` tells apart different texts under one doc_id (their order is that of ``th``); it is 0 if no doc_id repeats.
    Repeated equal rows have equal keys: operators treat them as one document and return its result for each.
    Other columns of the input, whatever their names, are left out.
    """
    small_batches(docs.sparkSession)
    did = F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    repeats = not docs.select(did.alias("did")).groupBy("did").count().filter("count > 1").isEmpty()
    th = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), did.alias("did"), th.alias("th"), text.alias("text"), *(docs[c] for c in more))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def merged(packed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches [start, end) from packed window ranges ``lo << 32 | hi``; touching ones are one."""
    if len(packed) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.sort(packed)
    lo, end = packed >> 32, np.maximum.accumulate((packed & 0xFFFFFFFF) + width)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    first = np.flatnonzero(new)
    return lo[first], end[np.append(first[1:], len(lo)) - 1]
