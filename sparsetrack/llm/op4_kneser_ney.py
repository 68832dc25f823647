"""Quality by an interpolated modified Kneser-Ney character model, trained on trusted text for each language.

Counting: tasks count the ``ORDER``-grams of trusted documents batch by batch; sums, continuation counts, the discounts
D1, D2, D3+ (from counts of counts, for each language and order) and the interpolation weights are joins and aggregates
sharded by gram or context.  Every order's table holds interpolated log probabilities of the grams seen and, for contexts,
the log weight of the next lower order.  Scoring: the tables are written in ``PARTS`` parts by a gram's last two
context symbols, and parts are put together to shards of about ``SHARD_ROWS`` rows, so every position finds all its orders
in one shard (grams of two symbols or fewer are in each).  Tasks read a
shard from the shared folder (nothing of the model passes through the driver but its row counts by part), and a
document's sums over the shards give its perplexity.  A document is kept if its perplexity is at most its language's ``QUANTILE`` among trusted
documents held out from training (crc32 of doc_id as text, modulo 5, is 0).

Symbols are bytes' worth: 0 before a text and for white space runs, printable ASCII and Latin-1 letters as they are;
characters from U+0100 on are dealt by a hash of their code point to the 96 numbers left (in scripts of many characters some
share one), and 1 is for all else.  Null and empty texts have no perplexity and are kept; so are languages (null is one) without trusted
text.  Rows of one doc_id are scored each by itself.  Labels of a doc_id that disagree trust it.  Empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import enter, fresh_dir, kept, settle, small_batches, written

ORDER, QUANTILE, SHARD_ROWS, PARTS = 5, 0.995, 4_000_000, 64
_SYMBOL = np.full(0x100, 1, np.uint8)
_SYMBOL[0x21:0x7F] = np.arange(0x21, 0x7F)
_SYMBOL[0xC0:0x100] = np.arange(0xC0, 0x100)
_SYMBOL[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
_FREE = np.array([*range(2, 33), *range(127, 192)])
SYMBOLS = 256
#: The part of each pair of last context symbols.
PART = (np.arange(SYMBOLS**2) * 40503 % SYMBOLS**2 % PARTS).astype(np.int64)


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    x = np.where(points < 0x100, _SYMBOL[np.minimum(points, 0xFF)], _FREE[points * np.uint32(2654435761) % len(_FREE)]).astype(np.int64)
    return x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))] if len(x) else x


def codes_of(x: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each symbol, padded in front with 0, as base-256 numbers."""
    padded = np.concatenate((np.zeros(order - 1, np.int64), x))
    code = np.zeros(len(x), np.int64)
    for j in range(order):
        code = code * SYMBOLS + padded[j : j + len(x)]
    return code


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            by.setdefault(lang, []).append(codes_of(symbols_of(text.as_py())))
        for lang, parts in by.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])


def train(trusted: DataFrame) -> DataFrame:
    """(lang, k, code, logp, logw): of each gram of k symbols its log probability; where it is a context, its log weight."""
    grams = {ORDER: written(trusted.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before a gram
        grams[k] = grams[k + 1].groupBy("lang", (F.col("code") % SYMBOLS**k).alias("code")).agg(F.count("*").alias("n"))
    table = None
    lower = None
    for k in range(1, ORDER + 1):
        g = grams[k]
        d = g.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("types"))
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.0))
        discount = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)]
        d = d.select("lang", *discount)
        g = g.join(F.broadcast(d), "lang")  # a row per language
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        g = g.select("lang", "code", (F.col("code").cast("long") / SYMBOLS).cast("long").alias("context"), "n", taken.alias("taken"))
        c = g.groupBy("lang", "context").agg(F.sum("n").alias("all"), F.sum("taken").alias("off"))
        g = g.join(c, ["lang", "context"]).select("lang", "code", "context", ((F.col("n") - F.col("taken")) / F.col("all")).alias("own"), (F.col("off") / F.col("all")).alias("w"))
        if lower is None:
            p = g.select("lang", "code", (F.col("own") + F.col("w") / SYMBOLS).alias("p"))
        else:
            below = lower.select("lang", F.col("code").alias("rest"), F.col("p").alias("q"))
            p = g.withColumn("rest", F.col("code") % SYMBOLS ** (k - 1)).join(below, ["lang", "rest"]).select("lang", "code", (F.col("own") + F.col("w") * F.col("q")).alias("p"))
        lower = written(p, f"order{k}")
        weights = c.select("lang", F.lit(k - 1).alias("k"), F.col("context").alias("code"), F.lit(None).cast("double").alias("logp"), F.log(F.col("off") / F.col("all")).alias("logw"))
        rows = lower.select("lang", F.lit(k).alias("k"), "code", F.log("p").alias("logp"), F.lit(None).cast("double").alias("logw")).union(weights)
        table = rows if table is None else table.union(rows)
    return table


class Model:
    """One shard: sorted codes of each language and order."""

    def __init__(self, raw: dict):
        self.of: dict[str, dict] = {}
        for lang, k, code, value, kind in raw:
            order = np.argsort(code)
            self.of.setdefault(lang, {})[(k, kind)] = code[order], value[order]

    def __call__(self, lang: str, x: np.ndarray, mine: np.ndarray) -> tuple[float, int] | None:
        """The sum of log probabilities at the positions whose part is marked in ``mine``, and their number."""
        m = self.of.get(lang)
        if m is None:
            return None
        code = codes_of(x)
        code = code[mine[PART[(code // SYMBOLS) % SYMBOLS**2]]]
        if not len(code):
            return 0.0, 0
        # a gram's probability is found once; what repeats is counted
        code, times = np.unique(code, return_counts=True)
        total, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        for k in range(ORDER, 0, -1):
            i = np.flatnonzero(open_)
            if not len(i):
                break
            gram = code[i] % SYMBOLS**k
            found, value = self._look(m.get((k, "p")), gram)
            total[i[found]] += value[found]
            open_[i[found]] = False
            rest = i[~found]
            has, weight = self._look(m.get((k - 1, "w")), (gram[~found] // SYMBOLS))
            total[rest[has]] += weight[has]
        total[open_] -= np.log(SYMBOLS)
        return float(total @ times), int(times.sum())

    @staticmethod
    def _look(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None or not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]


_loaded: dict[tuple, Model] = {}
kept(_loaded.clear)


def _load(path: str, parts: tuple[int, ...]) -> Model:
    """A shard from its folders; a worker keeps one at a time."""
    if (path, parts) not in _loaded:
        _loaded.clear()
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        raw = []
        if parts:
            part = pa.concat_tables(pyarrow.parquet.read_table(f"{inner}/last={n}", filesystem=fs, partitioning=None, read_dictionary=["lang"]) for n in parts).unify_dictionaries().combine_chunks()
            names = part.column("lang").combine_chunks()
            lang, k = names.indices.to_numpy(), part.column("k").to_numpy()
            code, logp, logw = (part.column(c).to_numpy() for c in ("code", "logp", "logw"))
            for i, name in enumerate(names.dictionary.to_pylist()):
                for order in range(ORDER + 1):
                    mine = (lang == i) & (k == order)
                    for kind, value in (("p", logp), ("w", logw)):
                        of = mine & ~np.isnan(value)
                        if of.any():
                            raw.append((name, order, code[of], value[of], kind))
        _loaded[(path, parts)] = Model(raw)
    return _loaded[(path, parts)]


def _score(path: str, parts: tuple[int, ...], mine: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        model = _load(path, parts)
        for b in it:
            got = [model(lang, symbols_of(text.as_py()), mine) for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True)]
            out = [pa.array([None if g is None else g[i] for g in got], t) for i, t in ((0, pa.float64()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "lang")), *out], names=["row", "doc_id", "lang", "logp", "n_symbols"])

    return run


def _shards(counts: dict[int, int], shard_rows: int) -> list[list[int]]:
    """Parts put together, the largest first, while a shard stays within ``shard_rows``; a larger one is alone."""
    out: list[list[int]] = []
    room: list[int] = []
    for part in sorted(counts, key=lambda c: (-counts[c], c)):
        i = next((i for i, left in enumerate(room) if left >= counts[part]), None)
        if i is None:
            out.append([])
            room.append(shard_rows)
            i = len(out) - 1
        out[i].append(part)
        room[i] -= counts[part]
    return out or [[]]


def perplexity(docs: DataFrame, model: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(row, doc_id, lang, logp, n_symbols) for each document."""
    spark, path = docs.sparkSession, fresh_dir(docs.sparkSession, "model")
    # grams and contexts of few symbols (at most 2 * SYMBOLS * (SYMBOLS + 1) rows a language) belong to every shard
    common = F.col("k") <= F.when(F.col("logw").isNull(), 2).otherwise(1)
    context = F.when(F.col("logw").isNull(), F.shiftright("code", 8)).otherwise(F.col("code")).bitwiseAND(SYMBOLS**2 - 1)
    placed = model.withColumn("last", F.when(common, F.lit(PARTS)).otherwise((context * 40503 % SYMBOLS**2 % PARTS).cast("int")))
    placed.repartition("last", F.col("code") % 5).write.option("compression", "zstd").partitionBy("last").parquet(path)
    settle(spark)
    read = spark.read.schema("lang string, k int, code long, logp double, logw double, last int").parquet(path)
    counts = {r["last"]: r["count"] for r in read.groupBy("last").count().collect()}  # at most PARTS + 1 rows
    everywhere = [PARTS] if counts.pop(PARTS, 0) else []
    groups = _shards(counts, shard_rows)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    # sums of several shards meet again by the row's content; one shard needs no key
    rows = rows.withColumn("row", F.xxhash64("doc_id", "lang", "text") if len(groups) > 1 else F.lit(0).cast("long"))
    scored = None
    for i, group in enumerate(groups):
        mine = np.zeros(PARTS, bool)
        mine[group] = True
        if i == 0:  # contexts that the model hasn't seen
            mine[[c for c in range(PARTS) if c not in counts]] = True
        piece = rows.mapInArrow(_score(path, (*everywhere, *sorted(group)), mine), "row long, doc_id long, lang string, logp double, n_symbols long")
        scored = piece if scored is None else scored.union(piece)
    if len(groups) > 1:
        # rows that are alike are summed together and told apart again
        one = scored.groupBy("row", "doc_id", "lang").agg(F.sum("logp").alias("logp"), F.sum("n_symbols").alias("n_symbols"), (F.count("*") / len(groups)).cast("int").alias("copies"))
        scored = one.select("row", "doc_id", "lang", (F.col("logp") / F.col("copies")).alias("logp"), (F.col("n_symbols") / F.col("copies")).cast("long").alias("n_symbols"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    return scored


def quality(docs: DataFrame, labels: DataFrame, q: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per document: doc_id, lang, n_symbols, perplexity, threshold, keep."""
    small_batches(docs.sparkSession)
    good = labels.where("quality = 1 and doc_id is not null").select(labels["doc_id"].cast("long").alias("doc_id")).distinct()
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # a merge join at every size: labels grow with the documents
    model = train(text.join(good.where(~apart).hint("merge"), "doc_id", "left_semi"))
    scored = written(perplexity(docs, model, shard_rows).select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(-F.col("logp") / F.col("n_symbols"))).alias("perplexity")), "scored")
    bound = scored.join(good.where(apart), "doc_id", "left_semi").groupBy("lang").agg(F.percentile_approx("perplexity", q, 10_000).alias("threshold"))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return scored.join(F.broadcast(bound), "lang", "left").select("doc_id", F.when(F.col("lang") != "", F.col("lang")).alias("lang"), "n_symbols", "perplexity", "threshold", keep.alias("keep"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)
