"""Toxicity of noisy texts: a noisy channel restores words, then a trained score reads the restored text.

Channel: leetspeak (digits and signs for letters), letters spaced or dotted apart, repeated letters.  A word that shows
any of these becomes a lattice of readings; Viterbi decoding under a character trigram model, counted over the whole
corpus, picks one.  Other words stay as they are.

Score: from a bounded sample of labelled rows (at most ``SAMPLE`` of either label, those with the smallest hashes of
their ids) features of the restored words are chosen that tell the labels apart: whole words and word beginnings, either as
met at all or as met often, at one of the shares ``DENSE`` of a document's distinct words.  At most ``CANDIDATES`` features,
those of the most toxic rows, are looked at, and at most ``CHOSEN`` are chosen: greedily, each for the toxic rows that those
before it explain little; near copies count once, so a text with many copies adds no accidental words.  A logistic function
of the features found gives the score.  Rows held out (crc32 of doc_id as text, modulo 5, is 0) and rows without a label
teach nothing.  Labels, lang, source and doc_id are no inputs of a score.

Null texts are empty; an empty text scores the base rate of texts without features.  A null doc_id is held out by the
crc32 of an empty text (0).  Rows of one doc_id are scored each by itself.  Without labels of both kinds the score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import enter, settle, small_batches, written
from .windows import U, mix, word_hashes


SAMPLE, CANDIDATES, CHOSEN, SUPPORT, AGAINST = 4_000, 20_000, 400, 3, 3
#: Shares of a document's distinct words from which on a feature counts as frequent (two words at least).
DENSE = (0.005, 0.01, 0.02, 0.04)
#: Words a worker remembers to hold nothing of interest (bounds its memory, not the result).
REMEMBERED = 400_000
# Signs read as letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
BETWEEN = frozenset(".-_*~'`,:;/\\ ")
EDGE = "\"'`.,:;!?()[]{}<>|*_-~#%&$+=/\\"
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_NARROW = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_GAP = re.compile(r"\s+")
_NOISY = re.compile(r"([^\W\d_])\1|(.)\2\2|[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_][\d_@$!|+€(]|[\d@$!|+€(][^\W\d_]", re.DOTALL)
#: Character classes of the model: 0 a word's edge, then a-z, the letters U+00DF..U+00FF, and one for all else.
CLASSES = 64
_CLASS = np.full(0x250, 63, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = 1 + _i
for _i in range(0xDF, 0x100):
    _CLASS[_i] = 27 + _i - 0xDF
    if 0xE0 <= _i and _i not in (0xF7, 0xFF):
        _CLASS[_i - 32] = 27 + _i - 0xDF


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 0x250, _CLASS[np.minimum(points, 0x24F)], 63)


def _class(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < 0x250 else 63


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for b in it:
        for text in b.column("text"):
            raw = text.as_py() or ""
            for at in range(0, len(raw), 1 << 20):
                x = classes_of(f" {raw[at : at + (1 << 20)]} ")
                x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
                total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(c | a, b) as a cube: trigram, bigram and unigram shares, mixed.  At most 64**3 counts come to the driver."""
    counts = np.zeros(CLASSES**3)
    counted = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(_count, "code long, n long")
    for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
    p3 = three / np.maximum(three.sum(axis=2, keepdims=True), 1)
    return np.log(0.75 * p3 + 0.2 * p2[None] + 0.05 * p1[None, None])


def lattice(word: str) -> Iterator[list[tuple[str, float]]]:
    """Readings of each place with their channel costs."""
    i = 0
    while i < len(word):
        c, first, j = word[i], i == 0, i
        while j < len(word) and word[j] == c:
            j += 1
        run, i = j - i, j
        letters = LEET.get(c, "")
        if c.isalpha():
            options = [(c, 0.0 if run == 1 else 0.4 * (run - 1))]
            if run >= 2:
                options.append((c + c, 0.0 if run == 2 else 0.4 * (run - 2)))
        elif c in BETWEEN and not first:
            options = [("", 0.3 if c != " " else 0.2), (" ", 1.5 if c != " " else 1.0)]
        else:
            options = [(c, 9.0 * run), ("", (6.0 if c in "!|+(" or not letters else 12.0) * run)]
        options += [(x * min(run, 2), 0.7) for x in letters] + [(x, 0.9) for x in letters if run > 1]
        yield options


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest reading (Viterbi; the state is the last two classes).

    What the readings of all states begin with is settled and put aside, so words of any length are read in linear time.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    settled: list[str] = []
    for place, options in enumerate(chain(lattice(word), [[(" ", 0.0)]]), 1):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for reading, cost in options:
                x, y, s = a, b, score - cost
                for c in reading:
                    z = _class(c)
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in new or s > new[(x, y)][0]:
                    new[(x, y)] = (s, text + reading)
        states = new
        if place % 64 == 0:
            same = commonprefix([text for _, text in states.values()])
            settled.append(same)
            states = {k: (score, text[len(same) :]) for k, (score, text) in states.items()}
    return ("".join(settled) + max(states.values())[1]).strip()


def features(word: str) -> list[str]:
    """A word and its beginnings of three to eight letters."""
    return [f"{word}$", *(word[:n] for n in range(3, min(8, len(word)) + 1))]


def graded(counts: dict[str, int], words: int) -> set[str]:
    """Features met, and marked by a share those met often, from the number of distinct words each was met in."""
    out = set(counts)
    for f, n in counts.items():
        if n >= 2:
            out.update(f"{f}\t{share}" for share in DENSE if n >= share * words)
    return out


def _runs(text: str) -> list[str]:
    """Letters spaced apart, a blank between two: whole runs, and their parts where a wider gap may part words."""
    out: dict[str, None] = {}
    for m in _SPACED.finditer(text):
        gaps = _GAP.findall(m[0])
        out[_GAP.sub(" ", m[0])] = None
        least = min(map(len, gaps))
        if any(len(g) > least for g in gaps):
            out.update((_GAP.sub(" ", part), None) for part in re.split(rf"\s{{{least + 1},}}", m[0]))
        if any(g not in " \t" for g in gaps):
            out.update((n[0].replace("\t", " "), None) for n in _NARROW.finditer(m[0]))
    return list(out)


class Restorer:
    """Restored words of texts."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def reading(self, word: str) -> tuple[str, ...]:
        """The restored words of one spelt word."""
        bare = word.strip(EDGE)
        out = [bare] if bare else []
        core = word.strip("\"'`.,:;?)[]{}<>*_-~#%&=/\\")
        if len(core) > 2 and _NOISY.search(core) and sum(c.isalpha() or c in LEET for c in core) >= 3:
            out += [w.strip(EDGE) for w in decode(core, self.model).split()]
        return tuple(dict.fromkeys(w for w in out if w))

    def spaced(self, text: str) -> list[str]:
        """Words of letters spaced apart: a run's reading, and all of it as one word."""
        out: list[str] = []
        for run in _runs(text):
            if sum(c.isalpha() or c in LEET for c in run) >= 4:
                out += [w.strip(EDGE) for w in decode(run, self.model).split()]
                out.append(run.replace(" ", ""))
        return [w for w in out if w]


def _candidates(model):
    """Features of sampled rows with the labels' document counts, summed over some rows of a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        r = Restorer(model.value)
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            clean, toxic = ([v[i] for v in counts.values()] for i in (0, 1))
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], names=["f", "clean", "toxic"])
            counts.clear()
            return out

        for b in it:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                for f in _all_features(r, text.as_py() or ""):
                    counts.setdefault(f, [0, 0])[toxic] += 1
                if len(counts) > 100_000:
                    yield flush()
        yield flush()

    return run


def _all_features(r: Restorer, text: str) -> set[str]:
    text = text.lower()
    spelt = set(text.split())
    words = {w for x in spelt for w in r.reading(x)}
    words.update(r.spaced(text))
    counts: dict[str, int] = {}
    for w in words:
        for f in features(w):
            counts[f] = counts.get(f, 0) + 1
    return graded(counts, len(spelt))


def _group(text: str) -> int:
    """The smallest hash of a text's word triples: near copies mostly share it."""
    words = word_hashes(text.lower().encode())
    if len(words) < 3:
        return int(words[:1].view(np.int64).sum())
    return int(mix(words[:-2] * U(3) + words[1:-1] * U(5) + words[2:] * U(7)).min().view(np.int64))


def _present(model, wanted):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        r, number = Restorer(model.value), {f: i for i, f in enumerate(wanted.value)}
        for b in it:
            groups, found = [], []
            for x in b.column("text"):
                text = x.as_py() or ""
                groups.append(_group(text))
                found.append(sorted(number[f] for f in _all_features(r, text) if f in number))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(groups, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "grp", "found"])

    return run


def choose(rows: list[tuple[int, int, list[int]]], n: int) -> list[int]:
    """Greedy choice from rows (toxic, group, features found).

    Near copies (one group) weigh as one row.  A feature gains the weight of the toxic rows that have it, which falls with
    each feature chosen before for the same row, less a multiple of the clean rows that have it.
    """
    if not rows:
        return []
    size: dict[int, int] = {}
    for _, group, _ in rows:
        size[group] = size.get(group, 0) + 1
    weight = np.array([1 / size[g] if toxic else 0.0 for toxic, g, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(f) for _, _, f in rows])
    feature = np.array([f for _, _, found in rows for f in found], np.int64)
    if not len(feature):
        return []
    against = AGAINST * np.bincount(feature, weights=np.array([not t for t, _, _ in rows], float)[row])
    chosen: list[int] = []
    while len(chosen) < n:
        gain = np.bincount(feature, weights=weight[row], minlength=len(against)) - against
        gain[chosen] = -1
        best = int(gain.argmax())
        if gain[best] < SUPPORT:
            break
        chosen.append(best)
        weight[row[feature == best]] *= 0.3
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Weights (the bias last) by Newton steps with a ridge on all but the bias.

    Each row also teaches by each of its features alone (a toxic row by shares of one, a clean row by each in full), so a
    feature that mostly comes with others has a weight of its own.
    """
    n = x.shape[1]
    share = np.where(y > 0, 1 / np.maximum(x.sum(axis=1), 1), 1.0)[:, None] * x
    alone = np.eye(n)
    weight = np.concatenate((np.ones(len(y)), share[y > 0].sum(axis=0), share[y == 0].sum(axis=0)))
    x = np.c_[np.concatenate((x, alone, alone)), np.ones(len(weight))]
    y = np.concatenate((y, np.ones(n), np.zeros(n)))
    w, penalty = np.zeros(n + 1), np.append(np.full(n, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
    return w


def _score(model, chosen, carry: tuple[str, ...]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        r = Restorer(model.value)
        weights, bias = chosen.value
        wanted = {f.partition("\t")[0] for f in weights}
        heads = {f.rstrip("$")[:3] for f in wanted}
        clean: set[str] = set()
        hot: dict[str, tuple[str, ...]] = {}  # restored words that hold a wanted feature, by spelling

        for b in it:
            scores = []
            for text in b.column("text"):
                text = (text.as_py() or "").lower()
                spelt = set(text.split())
                if len(clean) > REMEMBERED:
                    clean.clear()
                for w in spelt.difference(clean).difference(hot):
                    found = tuple(x for x in r.reading(w) if x[:3] in heads and not wanted.isdisjoint(features(x)))
                    if found:
                        hot[w] = found
                    else:
                        clean.add(w)
                if len(hot) > REMEMBERED:
                    hot = {w: hot[w] for w in spelt if w in hot}
                words = {x for w in spelt.intersection(hot) for x in hot[w]}
                words.update(r.spaced(text))
                counts: dict[str, int] = {}
                for w in words:
                    for f in wanted.intersection(features(w)) if w[:3] in heads else ():
                        counts[f] = counts.get(f, 0) + 1
                z = bias + sum(weights[f] for f in sorted(graded(counts, len(spelt))) if f in weights)
                scores.append(0.0 if not weights else 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), *(b.column(c) for c in carry)], names=["doc_id", "score", *carry])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: tuple[str, ...] = (), teaching: DataFrame | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted and the columns ``carry``.

    ``teaching``: the documents of the labelled rows, if other than ``docs``.
    """
    small_batches(docs.sparkSession)
    spark, teaching = docs.sparkSession, docs if teaching is None else teaching
    taught = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    taught = taught.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    # at most 2 * sample rows: the bound of what is broadcast
    few = written(taught.where("toxic = 1").orderBy("h", "doc_id").limit(sample).union(taught.where("toxic = 0").orderBy("h", "doc_id").limit(sample)).select("doc_id", "toxic"), "sample")
    text = teaching.select(teaching["doc_id"].cast("long").alias("doc_id"), F.coalesce(teaching["text"].cast("string"), F.lit("")).alias("text"))
    rows = written(text.join(F.broadcast(few), "doc_id").select("text", "toxic"), "taught")
    model = spark.sparkContext.broadcast(character_model(teaching))
    counts = rows.repartition(12).mapInArrow(_candidates(model), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.where(f"toxic >= {SUPPORT} and toxic > {AGAINST} * clean").orderBy(F.col("toxic").desc(), "clean", "f").limit(CANDIDATES).select("f").collect()
    wanted = spark.sparkContext.broadcast([r["f"] for r in best])
    seen = [(r["toxic"], r["grp"], r["found"]) for r in rows.mapInArrow(_present(model, wanted), "toxic int, grp long, found array<int>").collect()]
    chosen = choose(seen, CHOSEN)
    place = {f: i for i, f in enumerate(chosen)}
    x, y = np.zeros((len(seen), len(chosen))), np.array([t for t, _, _ in seen], float)
    for i, (_, _, found) in enumerate(seen):
        for f in found:
            if f in place:
                x[i, place[f]] = 1
    weights, bias = {}, -30.0
    if len(chosen) and 0 < y.sum() < len(y):
        w = fit_logistic(x, y)
        weights, bias = {wanted.value[f]: float(max(0.0, w[i])) for i, f in enumerate(chosen)}, float(w[-1])
    settle(spark)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(docs[c] for c in carry if c not in ("doc_id", "text")))
    scored = base.mapInArrow(_score(model, spark.sparkContext.broadcast((weights, bias)), carry), "doc_id long, score double" + kinds)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity(docs, labels, carry=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select("doc_id", "text", "lang", "source", "n_chars")


