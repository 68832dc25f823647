"""Text and binary sinks.  Tasks make the text of their rows and write it into one file, each at its own place.

Rows are sorted into parts; a part's text goes to a table in the shared folder first, with its length and with what stands
before its first row (a header that is left out if the part before leads up to it).  The driver sees one row of facts for
each part, adds up places, and tasks write the table's chunks there, so the file must lie where all of them see it.
Writing a chunk twice does no harm, so lost executors don't either.  Other outputs (stdout, pipes) take the chunks in order.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the binary matrix: magic, version, alignment of its parts.
MATRIX_MAGIC, MATRIX_VERSION, ALIGN = 0x90916C6F6F547742, 1, 4096
#: Bytes at which a chunk is full: a thousand of them, whatever reads them at once, are small.
CHUNK = 1 << 15
CHUNKS = "part int, at long, n long, raw binary, lead binary, first string, last string"
#: A header's text for a row, and what must have come before the row, or comes after it, for the next to need none.
Header = tuple[Callable[[dict], str], Callable[[dict], tuple], Callable[[dict], tuple]]


def number(x: float | None, decimals: int) -> str:
    return "NA" if x is None else f"{x:.{decimals}f}"


def _chunks(rows: DataFrame, body: Callable[[dict], str | bytes], header: Header | None) -> DataFrame:
    """Chunks of the rows' text: their part, place in it, number of rows; the first with ``lead``, the header left open."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, text, n, size, lead, first, before = TaskContext.get().partitionId(), 0, [], 0, 0, None, None, None

        def full():
            raw = b"".join(text)
            return pa.RecordBatch.from_pylist([{"part": part, "at": at, "n": n, "raw": raw, "lead": lead, "first": first, "last": repr(before)}], schema), len(raw)

        schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("raw", pa.binary()), ("lead", pa.binary()), ("first", pa.string()), ("last", pa.string())])
        for b in it:
            for r in b.to_pylist():
                if header is not None:
                    key = header[1](r)
                    if before is None:
                        lead, first = header[0](r).encode(), repr(key)
                    elif key != before:
                        text.append(header[0](r).encode())
                        size += len(text[-1])
                    before = header[2](r)
                x = body(r)
                text.append(x if isinstance(x, bytes) else x.encode())
                size += len(text[-1])
                n += 1
                if size >= CHUNK:
                    out, long = full()
                    yield out
                    at, text, n, size, lead, first = at + long, [], 0, 0, None, None
        if text:
            yield full()[0]

    return rows.mapInArrow(run, CHUNKS)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table in the folder that all executors see, read again, and its path; a temporary folder only in local mode."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparsetrack-")
    path = f"{folder.rstrip('/')}/text-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _dropped(df: DataFrame, path: str) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _put(rows: DataFrame, out: IO, body: Callable[[dict], str | bytes], header: Header | None = None) -> int:
    """Write the rows, in their order, behind what ``out`` holds; their number."""
    chunks = _chunks(rows, body, header)
    name = getattr(out, "name", None)
    if not isinstance(name, str) or not os.path.isfile(name):
        before, n = None, 0
        for c in chunks.toLocalIterator():
            text = bytes(c["lead"] if c["lead"] is not None and c["first"] != before else b"") + bytes(c["raw"])
            out.write(text.decode())
            before, n = c["last"], n + c["n"]
        return n
    chunks, table = _written(chunks)
    out.flush()
    base = at = os.path.getsize(name)
    before, n, places = None, 0, []
    facts = chunks.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.octet_length("raw")).alias("size"), F.max("lead").alias("lead"), F.max("first").alias("first"), F.max_by("last", "at").alias("last"))
    for f in facts.orderBy("part").collect():  # one row a part
        led = f["lead"] is not None and f["first"] != before
        skip = len(f["lead"]) if led else 0
        places.append((f["part"], at, led, skip))
        before, n, at = f["last"], n + f["n"], at + skip + f["size"]
    if not places:
        _dropped(chunks, table)
        return 0
    known = rows.sparkSession.createDataFrame(places, "part int, base long, led boolean, skip long")
    place = F.col("base") + F.when(F.col("at") > 0, F.col("at") + F.col("skip")).otherwise(0)
    each = chunks.join(F.broadcast(known), "part").select(place.alias("place"), F.when(F.col("led") & F.col("lead").isNotNull(), F.concat("lead", "raw")).otherwise(F.col("raw")).alias("raw"))
    target = os.path.abspath(name)

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(target, "r+b") as f:
            for b in it:
                for at, raw in zip(b.column("place").to_pylist(), b.column("raw"), strict=True):
                    f.seek(at)
                    done += f.write(raw.as_buffer())
        yield pa.RecordBatch.from_pydict({"done": pa.array([done], pa.int64())})

    done = each.mapInArrow(fill, "done long").agg(F.sum("done")).first()[0]
    if done != at - base or os.path.getsize(name) != at:
        raise OSError(f"{target}: {done} of {at - base} bytes written; do all executors see it?")
    out.seek(0, os.SEEK_END)
    _dropped(chunks, table)
    return n


def _steps(kind: str, step: int, span: Callable[[dict], int]) -> Header | None:
    """Headers of fix or var text: a new one wherever rows don't follow each other."""
    if kind == "bg":
        return None
    text = lambda r: f"fixedStep chrom={r['chrom']} start={r['start'] + 1} step={step} span={step}\n" if kind == "fix" else f"variableStep chrom={r['chrom']} span={step}\n"
    return text, lambda r: (r["chrom"], r["start"]), lambda r: (r["chrom"], r["start"] + span(r))


def write_wig(signal: DataFrame, out: IO[str], kind: str = "var", decimals: int = 2) -> None:
    """kind: fix, var or bg; a new header wherever the signal has a gap."""

    def body(r: dict) -> str:
        value = number(r["value"], decimals)
        if kind == "bg":
            return f"{r['chrom']}\t{r['start']}\t{r['end']}\t{value}\n"
        return "".join((f"{pos + 1}\t" if kind == "var" else "") + value + "\n" for pos in range(r["start"], r["end"]))

    _put(signal.orderBy("chrom", "start"), out, body, _steps(kind, 1, lambda r: r["end"] - r["start"]))


def write_table(df: DataFrame, out: IO[str], columns: list[str], decimals: int = 2, order: list[str] | None = None, header: bool = False, missing: str = "NA", between: str = ",", labels: list[str] | None = None) -> None:
    """Tab-separated columns; arrays become lists, with ``between`` between their values."""
    if header:
        out.write("#" + "\t".join(labels or columns) + "\n")

    def text(v):
        if v is None:
            return missing
        if isinstance(v, float):
            return number(v, decimals)
        return between.join(map(text, v)) if isinstance(v, list) else str(v)

    rows = df.orderBy(*order) if order else df
    _put(rows.select(*dict.fromkeys(columns)), out, lambda r: "\t".join(text(r[c]) for c in columns) + "\n")


def write_steps(df: DataFrame, out: IO[str], columns: list[str], kind: str, decimals: int, order: list[str], step: int = 1) -> None:
    """Rows with start and end as bg, var or fix text; the latter two have a new header wherever rows don't follow each other."""

    def body(r: dict) -> str:
        values = "\t".join(number(r[c], decimals) for c in columns)
        if kind == "bg":
            return f"{r['chrom']}\t{r['start']}\t{r['end']}\t{values}\n"
        return (f"{r['start'] + 1}\t" if kind == "var" else "") + values + "\n"

    _put(df.orderBy(*order), out, body, _steps(kind, step, lambda _: step))


def write_listed(lines: DataFrame, out: IO[str], decimals: int = 2) -> None:
    """Values one below the other, under a line with the name of each region."""
    region = lambda r: (r["row_id"],)
    _put(lines.orderBy("row_id", "idx"), out, lambda r: number(r["value"], decimals) + "\n", (lambda r: f"# {r['name']}\n", region, region))


def write_words(words: DataFrame, out: IO[str], width: int = 60) -> None:
    """Symbolic words, 60 letters to a line under a name for each stretch."""

    def body(r: dict) -> str:
        lines = (r["word"][at : at + width] + "\n" for at in range(0, len(r["word"]), width))
        return f">{r['chrom']}:{r['start']}-{r['end']}\n" + "".join(lines)

    _put(words.orderBy("chrom", "start"), out, body)


def write_matrix(matrix: DataFrame, path: str, labels: bool = False) -> None:
    """The binary matrix: nine 64-bit numbers, rows of doubles at 4,096, then (optionally) the regions as text."""
    columns = [c for c in ("chrom", "start", "end", "name", "score", "strand") if c in matrix.columns]
    ordered = matrix.orderBy("row_id")
    with open(path, "wb") as out:
        out.write(b"\0" * ALIGN)
        rows = _put(ordered.select("values"), out, lambda r: np.array([np.nan if x is None else x for x in r["values"]], "<f8").tobytes())
        size = out.tell() - ALIGN
        at = -(-(ALIGN + size) // ALIGN) * ALIGN if labels else 0
        if labels:
            out.truncate(at)
            _put(ordered.select(*columns), out, lambda r: "\t".join(str(r[c]) for c in columns) + "\n")
        out.seek(0)
        out.write(struct.pack("<9Q", MATRIX_MAGIC, MATRIX_VERSION, 0, rows, size // (8 * rows) if rows else 0, 8, size, ALIGN, at))


def read_matrix(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        magic, _, _, rows, cols, _, size, at, _ = struct.unpack("<9Q", f.read(72))
        if magic != MATRIX_MAGIC:
            raise ValueError("not a binary matrix")
        f.seek(at)
        return np.frombuffer(f.read(size), "<f8").reshape(rows, cols)
