"""Suffix-array deduplication by depth-limited radix sort.

Every byte that lies in a ``width``-byte string which also starts earlier in the corpus (a smaller doc_id, or the same
document at an earlier place; overlaps count) is removed.  Suffixes are ordered only through their first ``width`` bytes,
by most-significant-digit passes: the groups that are equal after the last digit are exactly the repeated strings.  The
passes over all the corpus (``repeats``) have content digits: a suffix's anchor, which neighbouring suffixes share, and its
surroundings, so they move one row for a run of suffixes, not one for each.  Within an anchor the digits are the suffix's
own bytes, eight at a time, and a group is sorted on only while it has two suffixes or more.

Nulls: a null text is empty, a null doc_id comes before all others.  Rows that share a doc_id count as different
documents if their texts differ (in the order of their hashes), else as one.  Texts below ``width`` bytes stay whole.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import CROWD, MARKS, by_anchor, leaders, repeated
from .shared import keyed, merged, record

WIDTH, ANCHOR = 100, 16
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary()), ("clean_text", pa.string())])
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, clean_text string"


def _whole_characters(raw: bytes, start: np.ndarray, end: np.ndarray) -> str:
    """The text left when every character of which a byte is cut goes as a whole."""
    at, kept = 0, []
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        while s > at and raw[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(raw) and raw[e] & 0xC0 == 0x80:
            e += 1
        kept.append(raw[at:s])
        at = max(at, e)
    return b"".join([*kept, raw[at:]]).decode("utf-8", "replace")


def _cut(width: int, carry: tuple[str, ...], clean: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                raw = text.as_py()
                start, end = merged(np.array(spans.as_py() or [], np.int64), width)
                at, kept = 0, []
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((doc_id, len(raw), int((end - start).sum()), len(start), np.stack((start, end), 1).ravel().tolist(), b"".join(kept), _whole_characters(raw, start, end) if clean else None))
            own = record(OUT, zip(*out, strict=True) if out else [[]] * len(OUT))
            yield pa.RecordBatch.from_arrays([*own.columns, *(b.column(c) for c in carry)], names=[*OUT.names, *carry])

    return run


def radix_groups(group: np.ndarray, digits: list) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: ``digits`` are functions from row numbers to digit values.

    Returns the rows that are still with others after the last digit, in order, and their groups, numbered in that order.
    """
    rows = np.arange(len(group))
    for digit in [None, *digits]:
        value = np.zeros(len(rows), np.uint8) if digit is None else digit(rows)
        by = np.lexsort((value, group))
        rows, group, value = rows[by], group[by], value[by]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(rows)))
        keep = np.repeat(count > 1, count)
        rows, group = rows[keep], (np.cumsum(new) - 1)[keep]
        if not len(rows):
            break
    return rows, group


def _order_suffixes(width: int):
    """All suffixes of an anchor's runs, ordered through ``width`` bytes; those equal to an earlier one are marked."""

    def work(rows: list[dict]) -> pa.RecordBatch:
        length = np.array([len(r["tokens"]) for r in rows], np.int64)
        flat = np.frombuffer(b"".join(r["tokens"] for r in rows) + bytes(8), np.uint8).astype(np.uint64)
        eight = np.zeros(len(flat) - 7, np.uint64)  # the digit at each place: eight bytes, the first the highest
        for j in range(8):
            eight = eight << np.uint64(8) | flat[j : j + len(eight)]
        n = length - width + 1
        run = np.repeat(np.arange(len(rows)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(np.cumsum(length) - length, n) + start
        anchor = np.unique(np.array([r["akey"] for r in rows], np.int64), return_inverse=True)[1]
        places = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]  # the last digit may overlap
        which, group = radix_groups(anchor[run], [lambda i, at=at: eight[place[i] + at] for at in places])
        rank = leaders(rows, by_document=False)[run] * (width + int(n.max())) + start
        mine = rank[which]
        hit = which
        if len(which):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            hit = np.sort(which[mine > np.minimum.reduceat(mine, first)[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))]])
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (hit[1:] != hit[:-1] + 1) | (run[hit[1:]] != run[hit[:-1]])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
        of = run[hit[first]]
        did, th, lo = (np.array([r[c] for r in rows], np.int64)[of] for c in ("did", "th", "lo"))
        return record(MARKS, (did, th, (lo + start[hit[first]]) << 32 | (lo + start[hit[last]])))

    return by_anchor(work)


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, crowd: int = CROWD, carry: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, spans ([start, end, ...] in bytes), kept (the remaining
    bytes), clean_text (only if asked for: the text without any character that lost a byte) and the columns ``carry``."""
    base = keyed(docs, *carry)
    spans = repeated(base, "bytes", width, anchor, by_document=False, order=_order_suffixes(width), crowd=crowd)
    texts = base.select("did", "th", "doc_id", F.col("text").cast("binary").alias("text"), *carry)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    return texts.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans", *carry).mapInArrow(_cut(width, carry, clean), OUT_SQL + kinds)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated strings cut out; a character of which a part was cut goes as a whole."""
    found = remove_repeats(docs, carry=("lang", "source"), clean=True)
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))
