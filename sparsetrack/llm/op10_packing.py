"""Shortest-pack-first packing over the histogram of lengths.

Texts become ids (end id last) and are cut into pieces of ``width`` ids and a rest.  Only the histogram of piece lengths,
``width`` counts, comes to the driver.  Lengths are placed longest first, each into the pack with the most room left (the
shortest pack); packs of one filling are one pattern with a count.  Should that leave over ``slack`` of padding, the rests
are cut finer (at the largest half, quarter or eighth of the width that leaves less) and packed again.  Pieces find their place by rank: a range sort by (length, document) numbers the pieces
of each length, and slot r of a length belongs to piece r.  No length, however common, meets in one task.

A sequence of ``width`` ids, or of a power of two, has no padding; others are padded to ``width``.

Null texts are empty (their end id alone); null ids come first and stay null; repeated rows are packed each by itself.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import enter, ints, keyed, record, settle, written
from .tokenize import encoder, public_path

END, WIDTH = 1, 2048
PIECE = pa.schema([("doc_id", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECE_SQL = "doc_id long, did long, th long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def _pieces(vocabulary: str, width: int, cut: int, keep_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        enc = encoder(vocabulary)
        for b in it:
            for lo in range(0, b.num_rows, 200):
                part, out = b.slice(lo, 200), []
                for doc_id, did, th, raw in zip(*(part.column(c).to_pylist() for c in ("doc_id", "did", "th")), enc.encode_all(part.column("text").to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u2"), END).astype("<u4")
                    whole = len(ids) // width * width
                    for start, size in [*((at, width) for at in range(0, whole, width)), *((at, cut) for at in range(whole, len(ids), cut))]:
                        piece = ids[start : start + size].tobytes()
                        out.append((doc_id, did, th, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece if keep_ids else None))
                yield record(PIECE, zip(*out, strict=True))

    return run


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that hold every length as often as the histogram has it.

    Lengths come longest first; each goes to the packs with the most room.  Only when no pack has room new ones begin.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (gap := max(room, default=0)) >= length:
            count, pattern = room[gap].pop()
            n = min(count, left)
            if count > n:
                room[gap].append((count - n, pattern))
            if not room[gap]:
                del room[gap]
            room.setdefault(gap - length, []).append((n, (*pattern, length)))
            left -= n
        if left:  # as many of one length to a new pack as fit
            each = width // length
            full, rest = divmod(left, each)
            for n, many in ((full, each), (1, rest)):
                if n and many:
                    room.setdefault(width - many * length, []).append((n, (length,) * many))
    return sorted((x for have in room.values() for x in have), key=lambda x: x[1], reverse=True)


def cut_finer(histogram: dict[int, int], width: int, cut: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for length, n in histogram.items():
        for size, many in ((length, 1),) if length == width else ((cut, length // cut), (length % cut, 1)):
            if size and many:
                out[size] = out.get(size, 0) + n * many
    return out


def padding(patterns: list[tuple[int, tuple[int, ...]]], width: int) -> float:
    """Padded share of all places; a power of two needs none."""
    used = sum(n * sum(p) for n, p in patterns)
    pad = sum(n * (width - sum(p)) for n, p in patterns if sum(p) & (sum(p) - 1))
    return pad / max(1, used + pad)


def slots_of(patterns: list[tuple[int, tuple[int, ...]]], width: int) -> dict[str, np.ndarray]:
    """Slots by length: ranks first .. of slot group i are offset[i] of sequences base[i] .. ; group i holds count[i] of them."""
    rows, sequence = [], 0
    for n, p in patterns:
        at = 0
        for length in p:
            rows.append((length, sequence, at, n))
            at += length
        sequence += n
    rows.sort()
    length, base, offset, count = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return {"begin": np.cumsum(count) - count, "base": base, "offset": offset, "length": length}


def _place(slots: dict[str, np.ndarray], part_base: dict[int, int]):
    """Slot groups lie in the order of lengths, as the pieces do: piece number n of all belongs to slot number n of all."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            mid = ints(b, "mid")
            rank = np.array([part_base[p] for p in (mid >> 33).tolist()], np.int64) + (mid & (1 << 33) - 1)
            group = np.searchsorted(slots["begin"], rank, "right") - 1
            assert (slots["length"][group] == ints(b, "length")).all()
            own = b.select([n for n in b.schema.names if n != "mid"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(slots["base"][group] + rank - slots["begin"][group]), pa.array(slots["offset"][group])], names=[*own.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, width: int = WIDTH, slack: float = 0.01, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and (if kept) ids, unsigned 32-bit little-endian."""
    spark, base, path = docs.sparkSession, keyed(docs).select("doc_id", "did", "th", "text"), vocabulary or public_path()

    def made(cut: int) -> DataFrame:
        pieces = base.mapInArrow(_pieces(path, width, cut, keep_ids), PIECE_SQL)
        return written(pieces if keep_ids else pieces.drop("ids"), "pieces")

    pieces = made(width)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``width`` rows
    patterns, best = shortest_pack_first(histogram, width), width
    for cut in (width // 2, width // 4, width // 8):
        if padding(patterns, width) > slack and cut:
            finer = shortest_pack_first(cut_finer(histogram, width, cut), width)
            if padding(finer, width) < padding(patterns, width):
                patterns, best = finer, cut
    if best < width:
        pieces = made(best)
    settle(spark)
    dealt = pieces.repartitionByRange("length", "did", "th", "start").sortWithinPartitions("length", "did", "th", "start")
    placed = written(dealt.withColumn("mid", F.monotonically_increasing_id()), "ranked")
    total, part_base = 0, {}
    for r in placed.groupBy(F.shiftright("mid", 33).alias("part")).count().orderBy("part").collect():  # a row per partition
        part_base[r["part"]] = total
        total += r["count"]
    fields = [f for f in placed.schema.fields if f.name != "mid"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return placed.mapInArrow(_place(slots_of(patterns, width), part_base), kinds).drop("did", "th")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("length", F.col("length").cast("long"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).withColumn("length", F.col("length").cast("long"))
