"""Text sources: signal text (fixed, variable, bedGraph), regions, sizes, chains, lists of files."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGNAL = "chrom string, start long, end long, value double"


def located(path: str) -> str:
    """A local file by its whole path, since Spark and its tasks have folders of their own; other paths as they are."""
    return os.path.abspath(path) if "://" not in path and os.path.exists(path) else path


class Steps:
    """Runs of the lines of a signal text, from any place in it: after ``since`` values under the step line ``header``.

    Positions in fixed and variable steps are 1-based there and 0-based here.
    """

    def __init__(self, header: str | None = None, since: int = 0):
        self.mode, self.chrom, self.at, self.step, self.width = "bed", "", 0, 1, 1
        self.header, self.since = header, since
        if header is not None:
            self._begin(header)
            self.at += since * self.step

    def _begin(self, header: str) -> None:
        self.mode, *options = header.split()
        o = dict(x.split("=", 1) for x in options)
        self.chrom, self.at, self.step, self.width = o["chrom"], int(o.get("start", 1)) - 1, int(o.get("step", 1)), int(o.get("span", 1))

    def rows(self, lines: Iterable[str], values: bool = True) -> Iterator[tuple[str, int, int, float]]:
        """Runs, or (not ``values``) nothing, but the place is kept."""
        for line in lines:
            f = line.split()
            if not f or f[0].startswith("#") or f[0] in ("track", "browser"):
                continue
            if f[0] in ("fixedStep", "variableStep"):
                self.header, self.since = line, 0
                self._begin(line)
                continue
            self.since += 1
            if not values:
                continue
            if len(f) == 4:
                yield f[0], int(f[1]), int(f[2]), float(f[3])
            elif self.mode == "fixedStep":
                yield self.chrom, self.at, self.at + self.width, float(f[0])
                self.at += self.step
            elif self.mode == "variableStep":
                yield self.chrom, int(f[0]) - 1, int(f[0]) - 1 + self.width, float(f[1])
            else:
                raise ValueError(f"no signal line: {line!r}")


def signal_rows(lines: Iterable[str]) -> Iterator[tuple[str, int, int, float]]:
    """Runs of one signal text."""
    return Steps().rows(lines)


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.Series]]:
    """Lines of a task, by file and block; those of a block follow each other."""
    for part in parts:
        key = part["path"] + "\0" + part["block"].astype(str)
        for _, mine in part.groupby((key != key.shift()).cumsum()):
            yield (mine["path"].iloc[0], int(mine["block"].iloc[0])), mine["value"]


def _ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last step line of each block, and how many values come after it."""
    found: dict[tuple[str, int], Steps] = {}
    for key, lines in _blocks(parts):
        for _ in found.setdefault(key, Steps()).rows(lines, values=False):
            pass
    yield pd.DataFrame([(*k, s.header, s.since) for k, s in found.items()], columns=["path", "block", "header", "since"])


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """A signal from one or more text files; NaN values are no data.

    Step lines hold for what follows them, so files are read twice, block by block: first for each block's last step line (a
    row for each block passes the driver), then for the values, with the step line that each block begins under.
    """
    lines = spark.read.text(located(path)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    begin: dict[tuple[str, int], tuple[str | None, int]] = {}
    before: dict[str, tuple[str | None, int]] = {}
    for r in lines.mapInPandas(_ends, "path string, block long, header string, since long").orderBy("path", "block").collect():
        header, since = before.get(r["path"], (None, 0))
        begin[(r["path"], r["block"])] = header, since
        before[r["path"]] = (header, since + r["since"]) if r["header"] is None else (r["header"], r["since"])

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple[str, int], Steps] = {}
        for key, block in _blocks(parts):
            if key not in open_:
                open_ = {key: Steps(*begin[key])}
            yield pd.DataFrame(list(open_[key].rows(block)), columns=["chrom", "start", "end", "value"])

    return lines.mapInPandas(parse, SIGNAL).where(~F.isnan("value"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions with row_id in file order; missing names, scores and strands are ``.``, 0 and ``+``; blocks become arrays."""
    lines = spark.read.text(located(path)).withColumn("row_id", F.monotonically_increasing_id()).where("value <> '' and not value rlike '^(#|track|browser)'")
    f = F.split("value", r"\s+")
    get = lambda i, kind: F.try_element_at(f, F.lit(i + 1)).try_cast(kind)
    ints = lambda i: F.transform(F.filter(F.split(get(i, "string"), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return lines.select(
        "row_id", get(0, "string").alias("chrom"), get(1, "long").alias("start"), get(2, "long").alias("end"), F.coalesce(get(3, "string"), F.lit(".")).alias("name"), F.coalesce(get(4, "double"), F.lit(0.0)).alias("score"),
        F.substring(F.coalesce(get(5, "string"), F.lit("+")), 1, 1).alias("strand"), get(6, "long").alias("thick_start"), get(7, "long").alias("thick_end"), get(8, "string").alias("rgb"), ints(10).alias("block_sizes"), ints(11).alias("block_starts"), F.size(f).alias("n_fields"),
    )


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(located(path), sep="\t", schema="chrom string, size long")


def chain_rows(lines: Iterable[str]) -> Iterator[tuple]:
    """The plain reading of a whole text, line by line; ``read_chain`` gives the same from splits."""
    head, t, q = None, 0, 0
    for line in lines:
        f = line.split()
        if not f or f[0].startswith("#"):
            continue
        if f[0] == "chain":
            head = f
            t, q = int(f[5]), int(f[10])
        else:
            n = int(f[0])
            yield head[12] if len(head) > 12 else "0", head[2], t, t + n, head[7], q, int(head[8]), head[9], int(head[5]), int(head[6])
            if len(f) == 3:
                t, q = t + n + int(f[1]), q + n + int(f[2])


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Chain blocks, one row each.

    Files are read in splits.  A block's place is its chain's start and the sum of the blocks and gaps before it: within a split
    a running sum; what a split leaves behind of its last chain, a row for each split, is carried to those after it.
    """
    raw = spark.read.text(located(path)).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    f = F.split("line", "\\s+")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    long = lambda c: c.cast("long")
    begins = at(0) == "chain"
    head = F.struct(
        F.coalesce(at(12), F.lit("0")).alias("chain_id"), at(2).alias("t_name"), long(at(5)).alias("chain_t_start"), long(at(6)).alias("chain_t_end"), at(7).alias("q_name"), long(at(8)).alias("q_size"), at(9).alias("q_strand"), long(at(10)).alias("chain_q_start")
    )
    lines = raw.where("line <> '' and line not like '#%'").select("file", "split", "n", F.when(begins, head).alias("head"), F.when(~begins, long(at(0))).alias("size"), *(F.when(~begins, long(F.coalesce(at(i), F.lit("0")))).alias(c) for i, c in ((1, "dt"), (2, "dq"))))
    w = Window.partitionBy("file", "split").orderBy("n")
    lines = lines.withColumn("chain", F.count("head").over(w))  # of the split; 0 for what belongs to an earlier one
    own = Window.partitionBy("file", "split", "chain").orderBy("n")
    moved = {c: F.coalesce(F.col("size") + F.col(d), F.lit(0)) for c, d in (("t", "dt"), ("q", "dq"))}
    lines = lines.withColumns({c: F.sum(m).over(own) - m for c, m in moved.items()} | {f"{c}_step": m for c, m in moved.items()}).withColumn("mine", F.last("head", ignorenulls=True).over(w))
    # a row for each split: its last chain, and how far its blocks have moved
    last = F.max("chain").over(Window.partitionBy("file", "split"))
    ends = lines.withColumn("last", last).groupBy("file", "split").agg(F.max_by("mine", "n").alias("open"), F.max((F.col("chain") > 0).cast("int")).alias("begins"), *(F.sum(F.when(F.col("chain") == F.col("last"), F.col(f"{c}_step")).otherwise(0)).alias(f"left_{c}") for c in "tq"))
    files = Window.partitionBy("file").orderBy("split")
    ends = ends.withColumn("since", F.sum("begins").over(files))
    so_far = Window.partitionBy("file", "since").orderBy("split")
    ends = ends.withColumns({f"left_{c}": F.sum(f"left_{c}").over(so_far) for c in "tq"} | {"open": F.last("open", ignorenulls=True).over(files)})
    carried = ends.select("file", "split", *(F.lag(c).over(files).alias(f"c_{c}") for c in ("open", "left_t", "left_q")))
    first = F.col("chain") == 0
    blocks = lines.where("size is not null").join(carried, ["file", "split"])
    blocks = blocks.select("size", F.when(first, F.col("c_open")).otherwise(F.col("mine")).alias("h"), *(F.when(first, F.col(f"c_left_{c}") + F.col(c)).otherwise(F.col(c)).alias(c) for c in "tq"))
    start = F.col("h.chain_t_start") + F.col("t")
    return blocks.select("h.chain_id", "h.t_name", start.alias("t_start"), (start + F.col("size")).alias("t_end"), "h.q_name", (F.col("h.chain_q_start") + F.col("q")).alias("q_start"), "h.q_size", "h.q_strand", "h.chain_t_start", "h.chain_t_end")


def chain_sizes(blocks: DataFrame) -> DataFrame:
    """Destination sizes as the chains state them."""
    return blocks.groupBy(F.col("q_name").alias("chrom")).agg(F.first("q_size").alias("size"))


def _there(path: str) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound


def _listed(path: str) -> list[str]:
    """Lines of a list of files, on this machine's file system or any other."""
    if "://" not in path:
        with open(path, encoding="utf-8") as f:
            return f.read().splitlines()
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(inner) as f:
        return f.read().decode().splitlines()


def labelled_files(names: str | list[str], index: int | None = None) -> list[tuple[str, str]]:
    """(label, path) of a comma list, or of a list file with optional labels in its second column; absent files are skipped."""
    paths = names.split(",") if isinstance(names, str) else list(names)
    if len(paths) == 1 and paths[0].endswith((".txt", ".list")) and _there(paths[0]):
        rows = [line.split() for line in _listed(paths[0])]
        out = [(f[1] if len(f) > 1 else f[0], f[0]) for f in rows if f and _there(f[0])]
    else:
        out = [(p, p) for p in paths]
    return out if index is None else out[index : index + 1]
