"""The indexed binary signal format (bigWig): a Spark data source and a writer, in plain Python.

Layout (public format description): a 64-byte header; a B+ tree of chromosome names; sections of up to 1,024 items,
zlib-compressed; an R-tree over the sections; a summary of the whole.  Values are 32-bit floats.
"""

from __future__ import annotations

import math
import shutil
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.storagelevel import StorageLevel

from ..plans.intervals import cut_at, sections_of, tiled
from .text import located

# Fixed values of the format.
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BLOCK, SLOT = 256, 1024
SCHEMA = "chrom string, start long, end long, value double"
#: A zoom level's cell: 32 bytes.
CELL = [("chrom", "u4"), ("start", "u4"), ("end", "u4"), ("covered", "u4"), ("least", "f4"), ("most", "f4"), ("total", "f4"), ("squares", "f4")]
ZOOMED = "chrom string, start long, end long, covered long, least double, most double, total double, squares double"
ZOOMED_NAMES = [x.split()[0] for x in ZOOMED.split(", ")]
LEVELS, FACTOR = 8, 10


def _open(path: str):
    if "://" not in path:
        return open(path, "rb")
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


class Section(InputPartition):
    def __init__(self, path: str, order: str, names: dict[int, str], blocks: list[tuple[int, int]], packed: bool):
        self.path, self.order, self.names, self.blocks, self.packed = path, order, names, blocks, packed


class File:
    """Header, chromosomes and index of a file."""

    def __init__(self, path: str):
        self.path, self.f = path, _open(path)
        raw = self._at(0, 64)
        self.order = "<" if struct.unpack("<I", raw[:4])[0] == MAGIC else ">"
        if struct.unpack(self.order + "I", raw[:4])[0] != MAGIC:
            raise ValueError(f"{path} is no bigWig")
        _, _, _, tree, _, index, _, _, _, summary, buffer, _ = struct.unpack(self.order + "IHHQQQHHQQIQ", raw)
        self.packed, self.summary_at = buffer > 0, summary
        self.chroms: dict[int, tuple[str, int]] = {}
        key, = struct.unpack(self.order + "I", self._at(tree + 8, 4))
        self._names(tree + 32, key)
        self.index = index
        levels, = struct.unpack(self.order + "H", raw[6:8])
        #: Reductions, and where their indexes lie.
        self.zooms = [(r, at) for r, _, _, at in struct.iter_unpack(self.order + "IIQQ", self._at(64, 24 * levels))]

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _names(self, at: int, key: int) -> None:
        leaf, _, n = struct.unpack(self.order + "BBH", self._at(at, 4))
        raw = self._at(at + 4, n * (key + 8))
        for i in range(n):
            part = raw[i * (key + 8) : (i + 1) * (key + 8)]
            if leaf:
                number, size = struct.unpack(self.order + "II", part[key:])
                self.chroms[number] = part[:key].rstrip(b"\0").decode(), size
            else:
                self._names(struct.unpack(self.order + "Q", part[key:])[0], key)

    def blocks(self, wanted, index: int | None = None) -> list[tuple[int, int]]:
        """Places and sizes of the sections that ``wanted(first chrom, first base, last chrom, last base)`` accepts."""
        out, open_ = [], [(self.index if index is None else index) + 48]
        while open_:
            at = open_.pop()
            leaf, _, n = struct.unpack(self.order + "BBH", self._at(at, 4))
            size = 32 if leaf else 24
            raw = self._at(at + 4, n * size)
            for i in range(n):
                c0, b0, c1, b1, *rest = struct.unpack_from(self.order + ("IIIIQQ" if leaf else "IIIIQ"), raw, i * size)
                if wanted(c0, b0, c1, b1):
                    if leaf:
                        out.append((rest[0], rest[1]))
                    else:
                        open_.append(rest[0])
        return sorted(out)


def columns(raw: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Of one section: chromosome number, starts, ends, values, as views or sums of views of its bytes."""
    chrom, start, _, step, width, kind, _, n = struct.unpack_from(order + "IIIIIBBH", raw)
    fields = {1: [("s", order + "u4"), ("e", order + "u4"), ("v", order + "f4")], 2: [("s", order + "u4"), ("v", order + "f4")], 3: [("v", order + "f4")]}
    x = np.frombuffer(raw, fields[kind], n, 24)
    first = x["s"].astype(np.int64) if kind < 3 else start + np.arange(n, dtype=np.int64) * step
    return chrom, first, x["e"].astype(np.int64) if kind == 1 else first + width, x["v"].astype(np.float64)


def ranges(blocks: list[tuple[int, int]], gap: int = 1 << 16, most: int = 1 << 23) -> Iterator[list[tuple[int, int]]]:
    """Sections in order of their places, gathered into stretches of the file that one read fetches."""
    held: list[tuple[int, int]] = []
    for at, n in blocks:
        if held and (at - sum(held[-1]) > gap or at + n - held[0][0] > most):
            yield held
            held = []
        held.append((at, n))
    if held:
        yield held


class Reader(DataSourceReader):
    """Comparisons of chrom, start and end reach the index: sections they exclude aren't read."""

    def __init__(self, path: str, per_task: int, zoom: int | None = None):
        self.path, self.per_task, self.chrom, self.low, self.high, self.zoom = path, per_task, None, 0, 1 << 32, zoom

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, EqualTo) and column == "chrom":
                self.chrom = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == "start":
                self.high = min(self.high, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == "end":
                self.low = max(self.low, f.value)
            yield f  # an index answers by sections, so Spark looks at the rows again

    def partitions(self):
        file = File(self.path)
        names = {i: n for i, (n, _) in file.chroms.items()}
        number = next((i for i, n in names.items() if n == self.chrom), -1)

        def wanted(c0, b0, c1, b1):
            if self.chrom is not None and not c0 <= number <= c1:
                return False
            return c0 != c1 or (b0 < self.high and b1 >= self.low)

        blocks = file.blocks(wanted, None if self.zoom is None else dict(file.zooms)[self.zoom])
        return [Section(self.path, file.order, names, blocks[i : i + self.per_task], file.packed) for i in range(0, len(blocks), self.per_task)] or [Section(self.path, file.order, names, [], file.packed)]

    def read(self, partition: Section):
        """Arrow batches, one for each stretch read."""
        names = pa.array(list(partition.names.values()), pa.string())
        place = {c: i for i, c in enumerate(partition.names)}
        with _open(partition.path) as f:
            for stretch in ranges(partition.blocks):
                base = stretch[0][0]
                f.seek(base)
                raw = f.read(sum(stretch[-1]) - base)
                if self.zoom is not None:
                    cells = [raw[at - base : at - base + n] for at, n in stretch]
                    x = np.concatenate([np.frombuffer(zlib.decompress(c) if partition.packed else c, [(n, partition.order + k) for n, k in CELL]) for c in cells])
                    number = np.array([place[c] for c in x["chrom"].tolist()], np.int64)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), *(pa.array(x[n].astype(np.float64 if k == "f4" else np.int64)) for n, k in CELL[1:])], names=ZOOMED_NAMES)
                    continue
                parts = []
                for at, n in stretch:
                    section = raw[at - base : at - base + n]
                    c, start, end, value = columns(zlib.decompress(section) if partition.packed else section, partition.order)
                    parts.append((np.full(len(start), place[c]), start, end, value))
                chrom, start, end, value = (np.concatenate(x) for x in zip(*parts, strict=True))
                sound = ~np.isnan(value)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(chrom[sound])), pa.array(start[sound]), pa.array(end[sound]), pa.array(value[sound])], names=["chrom", "start", "end", "value"])


class BigWig(DataSource):
    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return ZOOMED if "zoom" in self.options else SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("sections_per_task", 4096)), int(self.options["zoom"]) if "zoom" in self.options else None)


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    path = located(path)
    spark.dataSource.register(BigWig)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bigwig").load(path)


def bigwig_zooms(path: str) -> list[int]:
    """The file's reductions: bases to a cell."""
    return [r for r, _ in File(located(path)).zooms]


def read_zoom(spark: SparkSession, path: str, reduction: int) -> DataFrame:
    """Cells of a zoom level; only those with data are there."""
    path = located(path)
    spark.dataSource.register(BigWig)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bigwig").option("zoom", str(reduction)).load(path)


def zoomed_tiles(spark: SparkSession, path: str, width: int) -> DataFrame | None:
    """(chrom, start, end, num_data, min, max, mean, sum) of tiles of ``width`` bases with data, from the coarsest level whose
    cells fill them; None, if there is none.  Sums are of 32-bit numbers."""
    fit = [r for r in bigwig_zooms(path) if width % r == 0]
    if not fit:
        return None
    cells = read_zoom(spark, path, max(fit)).withColumn("start", F.floor(F.col("start") / width) * width)
    out = cells.groupBy("chrom", "start").agg(F.sum("covered").alias("num_data"), F.min("least").alias("min"), F.max("most").alias("max"), F.sum("total").alias("sum"))
    ends = F.broadcast(bigwig_sizes(spark, path)) if len(File(located(path)).chroms) < 100_000 else bigwig_sizes(spark, path)
    return out.join(ends, "chrom").select("chrom", "start", F.least(F.col("start") + width, "size").alias("end"), "num_data", "min", "max", (F.col("sum") / F.col("num_data")).alias("mean"), "sum")


def zoomed_graph(spark: SparkSession, path: str, every: int) -> DataFrame | None:
    """(chrom, middle, mean) of every tile of whole chromosomes, as ``chromgraph`` gives it, from a zoom level; None without one."""
    tiles = zoomed_tiles(spark, path, every)
    if tiles is None:
        return None
    grid = tiled(sections_of(bigwig_sizes(spark, path)), every)
    middle = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    return grid.join(tiles.select("chrom", "start", "mean"), ["chrom", "start"], "left").select("chrom", middle.alias("middle"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def bigwig_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(list(File(located(path)).chroms.values()), "chrom string, size long")


PACKED = "chrom string, first long, last long, raw binary, covered long, least double, most double, total double, squares double"


def _pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sections of sorted rows, without their chromosome's number; whole ones but at the end of a task or chromosome."""
    held = None
    for part in parts:
        held = part if held is None else pd.concat((held, part), ignore_index=True)
        yield from _sections(held, False)
        held = held.iloc[len(held) - _left(held) :].reset_index(drop=True)
    if held is not None:
        yield from _sections(held, True)


def _left(rows: pd.DataFrame) -> int:
    """Rows of the last section, which may go on."""
    return int((rows["chrom"] == rows["chrom"].iloc[-1]).sum() - 1) % SLOT + 1 if len(rows) else 0


def _sections(rows: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
    rows = rows if last else rows.iloc[: len(rows) - _left(rows)]
    out = []
    for chrom, mine in rows.groupby("chrom", sort=False):
        for at in range(0, len(mine), SLOT):
            x = mine.iloc[at : at + SLOT]
            items = np.rec.fromarrays((x["start"], x["end"], x["value"]), dtype="<u4,<u4,<f4")
            v, w = x["value"].to_numpy(), (x["end"] - x["start"]).to_numpy()
            out.append((chrom, x["start"].iloc[0], x["end"].iloc[-1], struct.pack("<H", len(x)) + items.tobytes(), w.sum(), v.min(), v.max(), (v * w).sum(), (v * v * w).sum()))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKED.split(", ")])


PACKED_CELLS = "chrom string, first long, last long, raw binary"


def _pyramid(signal: DataFrame, longest: int) -> list[tuple[int, DataFrame]]:
    """(reduction, cells) of the zoom levels: the first of some ten runs a cell, each of the others of ten cells of the one before."""
    rows = signal.where("value is not null").select("chrom", "start", "end", F.col("value").cast("float").cast("double").alias("value"))
    mean = rows.agg(F.avg(F.col("end") - F.col("start"))).first()[0]
    first = FACTOR ** math.ceil(math.log10(FACTOR * mean)) if mean else 0
    if not first or first >= longest:
        return []
    w = F.col("end") - F.col("start")
    cells = cut_at(rows, first).groupBy("chrom", "tile").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(w).alias("covered"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum(F.col("value") * w).alias("total"), F.sum(F.col("value") * F.col("value") * w).alias("squares"))
    cells = cells.persist(StorageLevel.DISK_ONLY)  # read by every level
    out = [(first, cells)]
    while len(out) < LEVELS and out[-1][0] * FACTOR < longest:
        merged = out[-1][1].groupBy("chrom", F.floor(F.col("tile") / FACTOR).alias("tile"))
        out.append((out[-1][0] * FACTOR, merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("covered").alias("covered"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))))
    return out


def _pack_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sections of sorted cells, without their chromosome's number."""
    for part in parts:
        out = []
        for chrom, mine in part.groupby("chrom", sort=False):
            for at in range(0, len(mine), SLOT):
                x = mine.iloc[at : at + SLOT]
                cells = np.zeros(len(x), [(n, "<" + k) for n, k in CELL])
                for n, _ in CELL[1:]:
                    cells[n] = x[n]
                out.append((chrom, int(x["start"].iloc[0]), int(x["end"].iloc[-1]), cells.tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKED_CELLS.split(", ")])


def _write_index(out, leaves: list[tuple[int, int, int, int, int]]) -> int:
    """The R-tree over sections (chromosome, first base, last base, place, size); where it lies."""
    index = out.tell()
    out.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, BLOCK, len(leaves), leaves[0][0], leaves[0][1], leaves[-1][0], leaves[-1][2], index, 1, 0))
    # levels from the leaves up; every node is written before the places above it are known, so sizes come first
    levels = [[leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)]]
    while len(levels[0]) > 1:
        nodes = levels[0]
        levels.insert(0, [nodes[i : i + BLOCK] for i in range(0, len(nodes), BLOCK)])

    def reach(x):
        while isinstance(x, list):
            lo, hi = x[0], x[-1]
            while isinstance(lo, list):
                lo = lo[0]
            while isinstance(hi, list):
                hi = hi[-1]
            return lo[0], lo[1], hi[0], hi[2]
        return x[0], x[1], x[0], x[2]

    at = out.tell()
    places = []
    for depth, nodes in enumerate(levels):
        row = []
        for node in nodes:
            row.append(at)
            at += 4 + len(node) * (32 if depth == len(levels) - 1 else 24)
        places.append(row)
    for depth, nodes in enumerate(levels):
        leaf, child = depth == len(levels) - 1, 0
        for node in nodes:
            out.write(struct.pack("<BBH", leaf, 0, len(node)))
            for x in node:
                out.write(struct.pack("<IIII", *reach(x)) + (struct.pack("<QQ", x[3], x[4]) if leaf else struct.pack("<Q", places[depth + 1][child])))
                child += not leaf
    return index


def write_bigwig(signal: DataFrame, sizes: DataFrame, path: str) -> None:
    """Write one file.  Tasks pack sections of sorted rows; these stream through the driver, which sets them one behind the
    other and writes the index (the format is one file in one order).  A path with a scheme is written by its file system.
    """
    if "://" in path:
        with tempfile.NamedTemporaryFile(suffix=".bw") as whole:  # the driver's own
            write_bigwig(signal, sizes, whole.name)
            fs, inner = pyarrow.fs.FileSystem.from_uri(path)
            with open(whole.name, "rb") as f, fs.open_output_stream(inner) as out:
                shutil.copyfileobj(f, out, 1 << 20)
        return
    chroms = sorted((r["chrom"], r["size"]) for r in sizes.collect())
    number = {n: i for i, (n, _) in enumerate(chroms)}
    key = max([1, *(len(n) for n, _ in chroms)])
    leaves: list[tuple[int, int, int, int, int]] = []
    stats = [0, np.inf, -np.inf, 0.0, 0.0]
    zooms = _pyramid(signal, max((size for _, size in chroms), default=0))
    with open(path, "wb") as out:
        out.write(b"\0" * (64 + 24 * len(zooms)))
        summary = out.tell()
        out.write(b"\0" * 40)
        tree = out.tell()
        out.write(struct.pack("<IIIIQQ", TREE_MAGIC, max(1, len(chroms)), key, 8, len(chroms), 0) + struct.pack("<BBH", 1, 0, len(chroms)))
        for i, (n, size) in enumerate(chroms):
            out.write(n.encode().ljust(key, b"\0") + struct.pack("<II", i, size))
        data = out.tell()
        out.write(b"\0" * 8)
        dealt = signal.where("value is not null").select("chrom", "start", "end", "value").repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
        for r in dealt.mapInPandas(_pack, PACKED).toLocalIterator():
            i, n = number[r["chrom"]], struct.unpack("<H", r["raw"][:2])[0]
            raw = zlib.compress(struct.pack("<IIIIIBBH", i, r["first"], r["last"], 0, 0, 1, 0, n) + r["raw"][2:])
            leaves.append((i, r["first"], r["last"], out.tell(), len(raw)))
            out.write(raw)
            stats = [stats[0] + r["covered"], min(stats[1], r["least"]), max(stats[2], r["most"]), stats[3] + r["total"], stats[4] + r["squares"]]
        if not leaves:
            raise ValueError("a signal without data can't be written")
        index = _write_index(out, leaves)
        headers = []
        for reduction, cells in zooms:
            at, mine, many = out.tell(), [], 0
            out.write(b"\0" * 4)
            dealt = cells.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
            for r in dealt.mapInPandas(_pack_cells, PACKED_CELLS).toLocalIterator():
                x = np.frombuffer(r["raw"], [(n, "<" + k) for n, k in CELL]).copy()
                x["chrom"] = number[r["chrom"]]
                raw = zlib.compress(x.tobytes())
                mine.append((number[r["chrom"]], r["first"], r["last"], out.tell(), len(raw)))
                out.write(raw)
                many += len(x)
            headers.append((reduction, 0, at, _write_index(out, mine)))
            end = out.tell()
            out.seek(at)
            out.write(struct.pack("<I", many))
            out.seek(end)
        if zooms:
            zooms[0][1].unpersist()
        out.write(struct.pack("<I", MAGIC))
        out.seek(0)
        out.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(zooms), tree, data, index, 0, 0, 0, summary, 1 << 16, 0))
        out.write(b"".join(struct.pack("<IIQQ", *h) for h in headers))
        out.seek(summary)
        out.write(struct.pack("<Qdddd", *stats))
        out.seek(data)
        out.write(struct.pack("<Q", len(leaves)))
