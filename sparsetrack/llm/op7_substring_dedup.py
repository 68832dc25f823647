"""Substring deduplication by seed and extend.

A seed is a winnowed anchor: the word gram with the smallest hash in some window of ``width`` words (``repeats``).
Documents meet on equal seeds.  From a seed all its occurrences are extended at once, word by word to the left and to the
right: at each step those that go on alike stay together, and one that goes on like no other has reached its end.  So no
pairs are made, yet what an occurrence shares with any other is known at every length.  Where left and right reach together
over ``width`` words or more and an occurrence in a document with a smaller doc_id goes as far, there is a repeat; adjacent
ones are joined to the maximal repeat of the seed, and maximal repeats of neighbouring seeds are merged.  Each word of them is
removed: a window of ``width`` words over it also starts in a document with a smaller doc_id.

Seeds whose surroundings are the same as far as windows reach are settled before (the whole context is extended at once),
and a seed with more different surroundings than a task compares (``crowd``) is dealt on by more of its windows' words.

Words are runs of characters other than space, tab, LF, VT, FF and CR, compared unchanged.  Null texts have none; a null
doc_id comes before all others.  Rows that share a doc_id count as different documents if their texts differ (in the
order of their hashes), else as one.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import CROWD, MARKS, by_anchor, leaders, repeated
from .shared import keyed, merged, record
from .windows import word_hashes

WIDTH, ANCHOR = 50, 8
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())])
OUT_SQL = "doc_id long, n_words long, n_removed long, spans array<long>, kept string"


def extended(seed: np.ndarray, token, reach: np.ndarray, depth: int) -> np.ndarray:
    """Classes of occurrences alike in their first d tokens, for d from 0 to ``depth``; -1 for those alike with no other.

    ``token(rows, d)`` gives the next tokens of rows, of which row i has ``reach[i]``.
    """
    out = np.full((depth + 1, len(seed)), -1, np.int32)
    rows, alike = np.arange(len(seed)), seed
    for d in range(-1, depth):
        if d >= 0:
            there = reach[rows] > d
            rows, alike = rows[there], alike[there]
        value = token(rows, d) if d >= 0 else np.zeros(len(rows), np.uint8)
        by = np.lexsort((value, alike))
        rows, alike, value = rows[by], alike[by], value[by]
        if not len(rows):
            break
        new = np.append(True, (alike[1:] != alike[:-1]) | (value[1:] != value[:-1]))
        count = np.diff(np.append(np.flatnonzero(new), len(rows)))
        keep = np.repeat(count > 1, count)
        rows, alike = rows[keep], (np.cumsum(new) - 1)[keep]
        out[d + 1, rows] = alike
    return out


def _extend(width: int, k: int):
    """Maximal repeats of the seeds' occurrences with an earlier document."""

    def work(rows: list[dict]) -> pa.RecordBatch:
        values = [word_hashes(r["tokens"]) for r in rows]
        length, at = np.array([len(v) for v in values], np.int64), np.array([r["at"] for r in rows], np.int64)
        flat, place = np.concatenate(values), np.cumsum(length) - length + at
        seed = np.unique(np.array([r["akey"] for r in rows], np.int64), return_inverse=True)[1]
        left = extended(seed, lambda i, d: flat[place[i] - 1 - d], at, width - k)
        right = extended(seed, lambda i, d: flat[place[i] + d], length - at, width)
        rank = leaders(rows, by_document=True)
        found = np.zeros((len(rows), width - k + 3), np.int8)  # by row and window start before the anchor, the farthest first
        for j in range(width - k + 1):
            i = np.flatnonzero((left[j] >= 0) & (right[width - j] >= 0))
            a, b = left[j, i], right[width - j, i]
            by = np.lexsort((rank[i], b, a))
            i, a, b = i[by], a[by], b[by]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(i)]
            first = i[np.flatnonzero(new)][np.cumsum(new) - 1] if len(i) else i
            found[i[rank[i] > rank[first]], width - k - j + 1] = 1
        edge = np.diff(found, axis=1)
        (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        did, th, lo = (np.array([r[c] for r in rows], np.int64)[row] for c in ("did", "th", "lo"))
        farthest = lo + at[row] - (width - k)
        return record(MARKS, (did, th, (farthest + begin) << 32 | (farthest + end - 1)))

    return by_anchor(work)


def _cut(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for doc_id, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                words = text.as_py().split()  # bytes.split() cuts at exactly the six characters
                start, end = merged(np.array(spans.as_py() or [], np.int64), width)
                at, kept = 0, []
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                out.append((doc_id, len(words), int((end - start).sum()), np.stack((start, end), 1).ravel().tolist(), b" ".join(kept).decode("utf-8", "replace")))
            yield record(OUT, zip(*out, strict=True) if out else [[]] * len(OUT))

    return run


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_words, n_removed, spans [start, end, ...] in words, kept: remaining words joined by a space), a row per document."""
    base = keyed(docs)
    spans = repeated(base, "words", width, anchor, by_document=True, order=_extend(width, anchor), crowd=crowd)
    texts = base.select("did", "th", "doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(width), OUT_SQL)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
