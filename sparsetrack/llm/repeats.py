"""Candidates for repeated windows of a corpus, exactly, without grouping all copies of a text in one task.

Each pass is on less data; what stands alone in a pass is not looked at again:

1. Windows are known by their anchor and their run's whole context (see ``windows``).  A mapper already settles what repeats
   within its own task and sends one row for it (a combiner: hot texts shrink to a row per task).  After one shuffle into
   ranges of (anchor, context), which split a hot anchor between tasks, a sorted stream settles equal contexts; anchors with
   two or more contexts go on, one row each, and so do anchors at the edge of a range, whose rest a neighbour may have.
2. Those rows fetch their run's tokens from the documents and are dealt by anchor; how an anchor's runs are compared is the
   operator's own method (``order``).  A crowded anchor, one with more contexts than a task's fair share, is dealt by its
   windows' own hashes instead, so no task gets it whole.
3. Marks are merged per document.

Equal contexts, and windows that stay crowded to the end, agree in two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import enter, ints, record, settle, written
from .windows import BASE, BASE2, BASE2_INV, BASE_INV, U, batches, byte_values, mix, prefix, span, word_hashes, word_spans

#: Contexts remembered by a task for combining (bounds its memory, not the result).
REMEMBERED = 400_000
#: Runs that are compared in one task (about 11 kB each); an anchor with more is dealt on.
CROWD = 10_000
#: Parts of a part in each round of dealing on.
PARTS = 4
#: Crowded anchors that are broadcast (16 bytes each); more are joined.
LISTED = 100_000
RUN, MARK, OPEN = 0, 1, 2
FOUND = pa.schema([("kind", pa.int8()), ("akey", pa.int64()), ("ckey", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("reach", pa.int32())])
#: ``reach``: the number of further window starts of the run, and behind it in sixteen bits the anchor's place after lo.
FOUND_SQL = "kind tinyint, akey long, ckey long, did long, th long, lo int, reach int"
SLICE = pa.schema([("akey", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("tokens", pa.binary())])
SLICE_SQL = "akey long, did long, th long, lo int, at int, tokens binary"
MARKS = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("span", pa.int64())])
MARKS_SQL = "did long, th long, span long"
WINDOW = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("lo", pa.int32())])
WINDOW_SQL = "w1 long, w2 long, did long, th long, lo int"


def values_of(unit: str):
    return byte_values if unit == "bytes" else word_hashes


def _scan(unit: str, width: int, k: int, by_document: bool):
    values = values_of(unit)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repeats")
        known: dict[tuple[int, int], tuple[int, int, int]] = {}

        def texts():
            for b in it:
                for did, th, text in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text"), strict=True):
                    yield (did, th), values(text.as_py())

        for keys, r in batches(texts(), width, k):
            if len(known) > REMEMBERED:
                known.clear()
            kind, anchor, context, lo = np.zeros(len(r.doc), np.int8), r.anchor.view(np.int64), r.context.view(np.int64), r.lo
            for i, (key, d, s) in enumerate(zip(zip(anchor.tolist(), context.tolist(), strict=True), r.doc.tolist(), lo.tolist(), strict=True)):
                mine = (*keys[d], s)
                least = known.setdefault(key, mine)
                if mine < least:
                    known[key] = mine
                elif mine > least and (not by_document or mine[:2] != least[:2]):
                    kind[i] = MARK  # known to repeat an earlier one
            # a marked row's key only spreads the rows
            anchor = np.where(kind == MARK, mix(np.arange(len(kind), dtype=U) + context.view(U)).view(np.int64), anchor)
            did = np.array([x[0] for x in keys], np.int64)[r.doc]
            th = np.array([x[1] for x in keys], np.int64)[r.doc]
            yield record(FOUND, (kind, anchor, np.where(kind == MARK, 0, context), did, th, lo.astype(np.int32), ((r.hi - lo) << 16 | (r.at - lo)).astype(np.int32)))

    return run


def _settle_contexts(by_document: bool):
    """Rows come sorted by (akey, ckey, did, th, lo); other tasks may have more of the first and of the last anchor."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = FOUND.names[1:]
        held = None  # the present context's rows from its leader's document, and whether their anchor has led another context
        held_open, edge = False, None
        for b in it:
            kind = ints(b, "kind")
            cols = {n: ints(b, n) for n in names}
            marks = kind == MARK
            if marks.any():
                yield record(FOUND, (np.full(marks.sum(), MARK, np.int8), *(cols[n][marks] for n in names)))
                cols = {n: c[~marks] for n, c in cols.items()}
            if not len(cols["akey"]):
                continue
            if held is not None:
                cols = {n: np.concatenate((held[n], c)) for n, c in cols.items()}
            a, c = cols["akey"], cols["ckey"]
            lead = np.ones(len(a), bool)
            lead[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(lead)
            context = np.cumsum(lead) - 1
            of = first[context]
            other = (cols["did"] != cols["did"][of]) | (cols["th"] != cols["th"][of])
            repeat = other if by_document else other | (cols["lo"] != cols["lo"][of])
            if repeat.any():
                yield record(FOUND, (np.full(repeat.sum(), MARK, np.int8), *(cols[x][repeat] for x in names)))
            same = a[first][1:] == a[first][:-1]
            edge = a[0] if edge is None else edge
            opened = a[first] == edge
            opened[1:] |= same
            opened[:-1] |= same
            if held is not None:
                opened[0] |= held_open
            # the last context waits: the next batch may hold its anchor's next one
            rest = ~repeat & (context == len(first) - 1)
            held, held_open = {x: cols[x][rest] for x in names}, bool(opened[-1])
            out = ~repeat & opened[context] & (context < len(first) - 1)
            if out.any():
                yield record(FOUND, (np.full(out.sum(), OPEN, np.int8), *(cols[x][out] for x in names)))
        if held is not None:
            yield record(FOUND, (np.full(len(held["akey"]), OPEN, np.int8), *(held[x] for x in names)))

    return run


def _slices(unit: str, width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for did, th, text, runs in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text"), b.column("runs"), strict=True):
                raw, runs = text.as_py(), runs.as_py()
                if unit == "words":
                    start, end = word_spans(np.frombuffer(raw, np.uint8))
                for r in runs:
                    lo, last = r["lo"], r["lo"] + (r["reach"] >> 16) + width
                    out.append((r["akey"], did, th, lo, r["reach"] & 0xFFFF, raw[lo:last] if unit == "bytes" else raw[start[lo] : end[last - 1]]))
                if len(out) > 20_000:
                    yield record(SLICE, zip(*out, strict=True))
                    out = []
            if out:
                yield record(SLICE, zip(*out, strict=True))

    return run


def parts(n: int, pieces: int) -> list[tuple[int, int]]:
    """The places 0 to n - 1 in so many pieces, (first, last) of each."""
    return [(n * p // pieces, n * (p + 1) // pieces - 1) for p in range(pieces) if n * p // pieces < n * (p + 1) // pieces]


def _deal(unit: str, width: int, k: int, pieces: int):
    """Each run cut into runs of windows that have the anchor in one piece of their places; a new ``akey`` of the old one,
    the piece and the text that all windows of the piece share."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repeats")
        for b in it:
            out: list[tuple] = []
            for akey, did, th, lo, at, raw in zip(*(b.column(c).to_pylist() for c in SLICE.names), strict=True):
                tokens = raw if unit == "bytes" else raw.split()
                joined = (lambda x: x) if unit == "bytes" else b" ".join
                further = len(tokens) - width
                for first, last in parts(width - k + 1, pieces):
                    near, far = max(first, at - further), min(last, at)
                    if near > far:
                        continue
                    key = b"%d %d " % (akey, first) + joined(tokens[at - first : at - last + width])
                    out.append((int.from_bytes(xxhash.xxh3_64_digest(key), "little", signed=True), did, th, lo + at - far, far, joined(tokens[at - far : at - near + width])))
                if len(out) > 20_000:
                    yield record(SLICE, zip(*out, strict=True))
                    out = []
            if out:
                yield record(SLICE, zip(*out, strict=True))

    return run


class Expanded:
    """All windows of some runs: of each its run and start; hashes of any slice of it."""

    def __init__(self, rows: list[dict], unit: str, width: int):
        values = [values_of(unit)(r["tokens"]) for r in rows]
        length = np.array([len(v) for v in values], np.int64)
        bounds = np.concatenate(([0], np.cumsum(length)))
        flat = np.concatenate(values)
        self.sums, self.sums2 = prefix(flat, BASE), prefix(flat, BASE2)
        n = length - width + 1
        self.run = np.repeat(np.arange(len(rows)), n)
        self.start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.place = bounds[self.run] + self.start

    def slice(self, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        return span(self.sums, self.place[rows] + a, self.place[rows] + b, BASE_INV)

    def second(self, a: int, b: int) -> np.ndarray:
        return span(self.sums2, self.place + a, self.place + b, BASE2_INV)


def leaders(rows: list[dict], by_document: bool) -> np.ndarray:
    """The rank of each run in the order of documents and places; runs that are alike have one rank."""
    did, th, lo = (np.array([r[n] for r in rows], np.int64) for n in ("did", "th", "lo"))
    by = np.lexsort((lo, th, did))
    rank = np.empty(len(rows), np.int64)
    d, t, s = did[by], th[by], lo[by]
    differs = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    if not by_document:
        differs |= s[1:] != s[:-1]
    rank[by] = np.cumsum(np.concatenate(([0], differs)))
    return rank


def by_anchor(work):
    """Rows come with an anchor's runs together; whole anchors are worked on, many at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repeats")
        held: list[dict] = []
        for b in it:
            for at in range(0, b.num_rows, 8_000):
                held += b.slice(at, 8_000).to_pylist()
                if len(held) >= 8_000 and held[0]["akey"] != held[-1]["akey"]:
                    cut = len(held)
                    while held[cut - 1]["akey"] == held[-1]["akey"]:
                        cut -= 1
                    yield work(held[:cut])
                    held = held[cut:]
        if held:
            yield work(held)

    return run


def _single_windows(unit: str, width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("repeats")
        for b in it:
            rows = b.to_pylist()
            for at in range(0, len(rows), 2_000):
                part = rows[at : at + 2_000]
                x = Expanded(part, unit, width)
                did, th, lo = (np.array([r[n] for r in part], np.int64)[x.run] for n in ("did", "th", "lo"))
                yield record(WINDOW, (mix(x.slice(np.arange(len(x.run)), 0, width)).view(np.int64), mix(x.second(0, width)).view(np.int64), did, th, (lo + x.start).astype(np.int32)))

    return run


def _alike(slices: DataFrame, unit: str, width: int, by_document: bool) -> DataFrame:
    """Marks of single windows that equal an earlier one, by their hashes."""
    alone = slices.mapInArrow(_single_windows(unit, width), WINDOW_SQL)
    place = ["did", "th"] + ([] if by_document else ["lo"])
    firsts = alone.groupBy("w1", "w2").agg(F.min(F.struct(*place)).alias("f"), F.count("*").alias("n")).filter("n > 1")
    later = alone.join(firsts, ["w1", "w2"]).filter(~F.struct(*place).eqNullSafe(F.col("f")))
    return later.select("did", "th", (F.shiftleft(F.col("lo").cast("long"), 32) + F.col("lo")).alias("span"))


def repeated(docs: DataFrame, unit: str, width: int, k: int, by_document: bool, order, crowd: int = CROWD) -> DataFrame:
    """Window starts that repeat an earlier one, of ``keyed`` documents: (did, th, spans array<long>, packed lo << 32 | hi).

    ``order``: the comparison of an anchor's runs, a function for mapInArrow from ``SLICE`` to ``MARKS`` rows.
    ``unit``: bytes or words.  Earlier means a smaller (document, start), or, ``by_document``, a smaller document.
    Documents without such windows have no row.
    """
    spark = docs.sparkSession
    texts = docs.select("did", "th", F.col("text").cast("binary").alias("text"))
    scanned = texts.mapInArrow(_scan(unit, width, k, by_document), FOUND_SQL)
    found = written(scanned.repartitionByRange("akey", "ckey").sortWithinPartitions("akey", "ckey", "did", "th", "lo").mapInArrow(_settle_contexts(by_document), FOUND_SQL), "runs")
    del scanned
    settle(spark)
    marks = found.filter(F.col("kind") == MARK).select("did", "th", (F.shiftleft(F.col("lo").cast("long"), 32) + F.col("lo") + F.shiftright("reach", 16)).alias("span"))
    still = found.filter(F.col("kind") == OPEN)
    runs = still.groupBy("did", "th").agg(F.collect_list(F.struct("akey", "lo", "reach")).alias("runs"))
    slices = runs.join(texts, ["did", "th"]).select("did", "th", "text", "runs").mapInArrow(_slices(unit, width), SLICE_SQL)
    few, pieces, known = None, 1, still
    while True:
        counts = known.groupBy("akey").count()
        crowded = written(counts.filter(F.col("count") > crowd).select("akey"), "crowded")
        n = crowded.count()
        if not n:
            few = slices if few is None else few.unionByName(slices)
            break
        if pieces == 1:
            slices = written(slices, "slices")
        listed = F.broadcast(crowded) if n <= LISTED else crowded
        calm = slices.join(listed, "akey", "left_anti")
        few = calm if few is None else few.unionByName(calm)
        many = slices.join(listed, "akey", "left_semi")
        if pieces > width - k:  # each is a single window, and a crowd of them all alike
            marks = marks.union(_alike(many, unit, width, by_document))
            break
        pieces *= PARTS
        slices = known = written(many.mapInArrow(_deal(unit, width, k, pieces), SLICE_SQL), "dealt")
        settle(spark)
    ordered = few.repartition("akey").sortWithinPartitions("akey").mapInArrow(order, MARKS_SQL)
    marks = marks.union(written(ordered, "windows"))
    settle(spark)
    return marks.groupBy("did", "th").agg(F.collect_list("span").alias("spans"))
