"""Benchmark decontamination with an FM-index for each training shard.

A shard is some hundred thousand words of whole documents.  Its words become ranks, its suffixes are sorted by prefix
doubling, and the Burrows-Wheeler transform is kept as a wavelet matrix with popcount ranks.  The windows of the benchmark
are searched backwards, all at once, by wavelet ranks; what is found is located by walking to sampled suffix places, and the
stretches are merged per document.  Nothing of a document leaves its task but its result: there is no shuffle.

Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.  A window is ``width`` consecutive words of an item; an
item of fewer words, but not none, is one window.  A benchmark of at most ``BLOCK_BYTES`` bytes is broadcast; a larger one
is written to the shared folder in files of about that size, and a task holds one of them at a time.  A document longer than
a shard is indexed in several, which share all but one word of a window; its results are put together again.

Null texts and items without words have no words; an item without an item_id still marks words but isn't named; items
that share an id count once.  Repeated documents get a row each.  An empty table on either side is fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import enter, fresh_dir, record, small_batches
from .windows import BASE, BASE2, BASE2_INV, BASE_INV, BYTE, PIECE, U, mix, prefix, span

WIDTH, SHARD_WORDS, SAMPLE, BLOCK_BYTES = 10, 400_000, 8, 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of a text's words, made piecewise."""
    raw = text.translate(_LOWER)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + 4 * PIECE)
        while end < len(raw) and _WORD[raw[end - 1]] and _WORD[raw[end]]:
            end += 1
        data = np.frombuffer(raw, np.uint8, end - at, at)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _WORD[data]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            out.append((mix(span(prefix(BYTE[data], BASE), start, stop, BASE_INV) + (stop - start).astype(U)), start + at, stop + at))
        at = end
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only groups that are still equal are sorted again.  The last symbols must differ."""
    n = len(rank)
    rank = rank.astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    new = np.ones(n, bool)
    new[1:] = rank[sa[1:]] != rank[sa[:-1]]
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = head[np.cumsum(new) - 1]
    size = np.diff(np.append(head, n))
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    h = 1
    while len(open_):
        at = sa[open_]
        key = (rank[at] << 32) | rank[np.minimum(at + h, n - 1)]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[at] = open_[head[group]]
        size = np.diff(np.append(head, len(at)))
        open_ = open_[(size > 1)[group]]
        h *= 2
    return sa


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        raw = np.concatenate((raw, np.zeros(16 - len(raw) % 8, np.uint8)))
        self.words = raw.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((U(1) << (i & 63).astype(U)) - U(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U) & U(1)).astype(np.int64)


class Wavelet:
    """A wavelet matrix: rank of any symbol before any place, and the symbol at any place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (symbols >> level) & 1
            self.levels.append((level, Bits(bit.astype(bool)), int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        p = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = (c >> level) & 1 == 1
            ri, rp = bits.rank(i), bits.rank(p)
            i, p = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rp, p - rp)
        return i - p

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at places, and their ranks before them."""
        c, p = np.zeros_like(i), np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = bits.get(i) == 1
            c |= one.astype(np.int64) << level
            ri, rp = bits.rank(i), bits.rank(p)
            i, p = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rp, p - rp)
        return c, i - p


class FMIndex:
    """Of documents given as word hashes; symbol 0 ends each document."""

    def __init__(self, docs: list[np.ndarray]):
        length = np.array([len(d) for d in docs], np.int64)
        self.vocabulary, ids = np.unique(np.concatenate(docs), return_inverse=True)
        n = int(length.sum()) + len(docs)
        ends = np.cumsum(length + 1) - 1
        symbols = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        symbols[inner] = ids + 1
        self.first = np.concatenate(([0], ends[:-1] + 1))
        order = symbols + len(docs)
        order[ends] = np.arange(len(docs))
        sa = suffix_array(order)
        self.bwt = Wavelet(symbols[sa - 1], len(self.vocabulary) + 1)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 1))))
        # every SAMPLE-th place and each document's first are kept, so that no walk passes an end
        mark = (sa % SAMPLE == 0) | np.isin(sa, self.first, assume_unique=False)
        self.sampled, self.places, self.n = Bits(mark), sa[mark], n

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 where the shard has none."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def search(self, symbols: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases of ``size`` symbols at some places (none of the symbols is -1)."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        live = np.arange(len(start))
        for j in reversed(range(size)):
            c = symbols[start[live] + j]
            lo[live], hi[live] = self.smaller[c] + self.bwt.rank(c, lo[live]), self.smaller[c] + self.bwt.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(lo, hi)
        gone = np.ones(len(start), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = self.sampled.get(rows[live]) == 1
            done = live[here]
            out[done] = self.places[self.sampled.rank(rows[done])] + steps[done]
            live = live[~here]
            c, r = self.bwt.get(rows[live])
            rows[live] = self.smaller[c] + r
            steps[live] += 1
        return out


class Phrases:
    """Windows of some items: the words of all of them behind each other, and where in them distinct windows start.

    Some 40 bytes a word while it is made, 24 afterwards: ``owner[bounds[i]:bounds[i + 1]]`` are the items of window i.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        words = [words_of((text or "").encode())[0] for _, text in items]
        size = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate([*words, np.zeros(0, U)])
        self.names = [item_id for item_id, _ in items]
        sums, sums2 = prefix(self.words, BASE), prefix(self.words, BASE2)
        first = np.cumsum(size) - size
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(size, width)[size > 0]).tolist():
            which = np.flatnonzero((size == n) if n < width else (size >= width))
            many = size[which] - n + 1
            item = np.repeat(which, many)
            start = np.repeat(first[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            a, b = mix(span(sums, start, start + n, BASE_INV)), span(sums2, start, start + n, BASE2_INV)
            by = np.lexsort((item, b, a))
            a, b, item, start = a[by], b[by], item[by], start[by]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            other = new.copy()
            other[1:] |= item[1:] != item[:-1]
            self.groups.append((n, start[new], np.append(np.flatnonzero(new[other]), other.sum()), item[other]))


def occurrences(index: FMIndex, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each phrase length: places in the shard, which phrase is there, and the items of phrases (bounds, owners)."""
    symbols = index.symbols(phrases.words)
    gone = np.concatenate(([0], np.cumsum(symbols < 0)))
    for n, start, bounds, owner in phrases.groups:
        there = np.flatnonzero(gone[start + n] == gone[start])
        if not len(there):
            continue
        lo, hi = index.search(symbols, start[there], n)
        count = hi - lo
        which = np.repeat(there, count)
        if len(which):
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            for at in range(0, len(rows), 1 << 18):
                yield n, index.locate(rows[at : at + (1 << 18)]), which[at : at + (1 << 18)], bounds, owner


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("clean_text", pa.string())])
OUT_SQL = "doc_id long, n_words long, n_hit long, spans array<long>, items array<string>, clean_text string"


def _files(path: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items of one file after the other."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    for f in sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.path.endswith(".parquet")):
        table = pyarrow.parquet.read_table(f, filesystem=fs, partitioning=None)
        yield list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True))


def _scan(sent, path: str | None, width: int, shard_words: int, carry: tuple[str, ...], clean: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontamination")
        phrases: list[Phrases] = []  # of the broadcast, made once
        held: list[tuple] = []
        size = 0

        def work():
            # a document longer than a shard is indexed in pieces that share all but one word of a window
            shards: list[list[tuple[int, int, np.ndarray]]] = [[]]
            room = shard_words
            for i, h in enumerate(held):
                for at in range(0, max(1, len(h[2]) - width + 1), shard_words):
                    piece = h[2][at : at + shard_words + width - 1]
                    if room < len(piece) and shards[-1]:
                        shards.append([])
                        room = shard_words
                    shards[-1].append((i, at, piece))
                    room -= len(piece) + 1
            if sent is not None and not phrases:
                phrases.append(Phrases(sent.value, width))
            hit, names = [np.zeros(len(h[2]), bool) for h in held], [set() for _ in held]
            for shard in shards:
                index = FMIndex([x[2] for x in shard])
                cover = np.zeros(index.n + 1, np.int32)
                for p in phrases if sent is not None else (Phrases(items, width) for items in _files(path)):
                    for n, places, which, bounds, owner in occurrences(index, p):
                        np.add.at(cover, places, 1)
                        np.add.at(cover, places + n, -1)
                        doc, which = np.unique(np.stack((np.searchsorted(index.first, places, "right") - 1, which)), axis=1)
                        many = bounds[which + 1] - bounds[which]
                        item = owner[np.arange(many.sum()) + np.repeat(bounds[which] - (np.cumsum(many) - many), many)]
                        for d, x in np.unique(np.stack((np.repeat(doc, many), item)), axis=1).T.tolist():
                            names[shard[d][0]].add(p.names[x])
                covered = np.cumsum(cover) > 0
                for (i, at, piece), first in zip(shard, index.first.tolist(), strict=True):
                    hit[i][at : at + len(piece)] |= covered[first : first + len(piece)]
            out = []
            for i, (doc_id, raw, words, start, end, _) in enumerate(held):
                mine = np.zeros(len(words) + 2, np.int8)
                mine[1:-1] = hit[i]
                edge = np.diff(mine)
                a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                text = None
                if clean:
                    at, kept = 0, []
                    for s, e in zip(start[a].tolist(), end[b - 1].tolist(), strict=True):
                        kept.append(raw[at:s])
                        at = e
                    text = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
                out.append((doc_id, len(words), int((b - a).sum()), np.stack((a, b), 1).ravel().tolist(), sorted(x for x in names[i] if x is not None), text))
            own = record(OUT, zip(*out, strict=True))
            rest = pa.concat_batches([h[5] for h in held]) if carry else None
            return pa.RecordBatch.from_arrays([*own.columns, *(rest.columns if carry else [])], names=[*OUT.names, *carry])

        for b in it:
            rest = b.select(list(carry)) if carry else None
            for i, (doc_id, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)):
                raw = text.as_py() or b""
                held.append((doc_id, raw if clean else None, *words_of(raw), rest.slice(i, 1) if carry else None))
                size += len(held[-1][2]) + 1
                if not clean:
                    held[-1] = (doc_id, None, held[-1][2], None, None, held[-1][5])
                if size >= shard_words:
                    yield work()
                    held, size = [], 0
        if held:
            yield work()

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, spans ([start, end, ...] in words), items, clean_text (if asked for:
    the text without the stretches, from first to last word) and the columns ``carry``.

    The benchmark is a query set.  Its size is measured first: up to ``block_bytes`` it is broadcast; beyond, nothing of it
    passes the driver, and tasks read it file by file.
    """
    small_batches(docs.sparkSession)
    spark, sent, path = docs.sparkSession, None, None
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    bytes_of = F.coalesce(F.octet_length("item_id"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    found = items.agg(F.coalesce(F.sum(bytes_of), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    if found["size"] <= block_bytes:
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
    else:
        path = fresh_dir(spark, "benchmark")
        items.repartition(min(found["n"], -(-found["size"] // block_bytes))).write.parquet(path)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"), *(docs[c] for c in carry))
    return texts.mapInArrow(_scan(sent, path, width, shard_words, carry, clean), OUT_SQL + kinds)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, benchmark)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the stretches found; no document goes as a whole."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("lang", "source"), clean=True)
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))
