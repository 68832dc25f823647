"""Ranked lexical search by NRA: impact-sorted lists are read in sequence, without random access.

Words: [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased, each by a 64-bit hash.  A first pass leaves of every
document its number of words, and the words that items ask for with their counts; what the score takes of the whole table
(documents, words, documents that hold a word) are aggregates of that.  Scores are integers: a word weighs
floor(1000 ln((2 N + 2) / (2 df + 1))), and adds weight * ((10**9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L.

A task takes its documents in blocks of at most ``BLOCK`` words asked for, so a frequent word's list is dealt out with the
documents.  In a block every word has a list of its documents, largest impact first.  For an item all its lists are read down
to a common impact, which falls from round to round.  A document's score lies between the impacts met so far and these plus
the next unread impact of each list it wasn't met in.  A document is given up once its upper bound is below the ``k``-th
largest lower bound, and new ones are no longer taken in once the unread impacts together are below it.  Reading ends when
the bounds of all that are left are equal, so members, ties and scores are exact.  The best of the blocks are ranked together.

Items are a stated query set: they are written to the shared folder in files, which tasks read one at a time; the vocabulary
asked for (8 bytes a word) is all that a task holds of them at once.

Null texts and texts without words have no words and don't count.  Every row of ``documents`` is a document, repeated ones
too; a null doc_id comes before all others.  Rows of one item_id are one item, that of the smallest text; a null item_id is
one, too.  Items without words, or whose words no document has, have no rows.  Empty tables give an empty result; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .op8_decontaminate import words_of
from .shared import LEAST, enter, fresh_dir, record, small_batches, written

K, BLOCK, ITEMS, ROUNDS = 20, 2_000_000, 2_000, 12
COUNTED = pa.schema([("did", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
COUNTED_SQL = "did long, n long, term array<int>, tf array<int>"
FOUND = pa.schema([("iid", pa.int64()), ("did", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "iid long, did long, score long"


def _files(path: str) -> Iterator[pa.Table]:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    for f in sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(inner)) if f.path.endswith(".parquet")):
        yield pyarrow.parquet.read_table(f, filesystem=fs, partitioning=None)


def _asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> their words with repeats counted."""
    schema = pa.schema([("iid", pa.int64()), ("word", pa.int64()), ("times", pa.int64())])
    for b in it:
        out = [(np.zeros(0, np.int64),) * 3]
        for iid, text in zip(b.column("iid").to_pylist(), b.column("text"), strict=True):
            word, times = np.unique(words_of(text.as_py())[0].view(np.int64), return_counts=True)
            out.append((np.full(len(word), iid), word, times))
        yield record(schema, (np.concatenate(c) for c in zip(*out, strict=True)))


def _count(path: str):
    """Documents -> their number of words and, by place in the sorted vocabulary, those asked for."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *(t.column("word").to_numpy() for t in _files(path))]))
        for b in it:
            did, n, term, tf = [], [], [], []
            for i, text in zip(b.column("did").to_pylist(), b.column("text"), strict=True):
                words = words_of(text.as_py())[0].view(np.int64)
                if not len(words):
                    continue
                at = np.minimum(vocabulary.searchsorted(words), max(0, len(vocabulary) - 1))
                found, times = np.unique(at[vocabulary[at] == words] if len(vocabulary) else at[:0], return_counts=True)
                did.append(i)
                n.append(len(words))
                term.append(found.astype(np.int32))
                tf.append(times.astype(np.int32))
            yield record(COUNTED, (did, n, term, tf))

    return run


class Lists:
    """The lists of a block: for each word its documents and parts of the score before weighting, largest first."""

    def __init__(self, did: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, many: int, total: int):
        self.did = did
        m = 75 + 25 * n * many // total
        part = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
        order = np.lexsort((-part, term))
        self.doc, self.part = np.repeat(np.arange(len(did)), sizes)[order], part[order]
        self.words, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(order))

    def best(self, words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and exact scores of the k best with a score above 0; how many entries were read."""
        at = np.minimum(self.words.searchsorted(words), max(0, len(self.words) - 1))
        have = (self.words[at] == words) & (weights > 0) if len(self.words) else np.zeros(len(words), bool)
        at, weights = at[have], weights[have]
        lo, hi = self.bounds[at], self.bounds[at + 1]
        if not len(lo):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        place, t = lo.copy(), len(lo)
        lower, met = np.zeros(len(self.did), np.int64), np.zeros((len(self.did), t), bool)
        live = np.arange(len(self.did))  # documents that may still be among the best
        among = np.ones(len(self.did), bool)
        ahead = self.part[lo] * weights
        for left in range(ROUNDS, -1, -1):
            limit = int(ahead.max()) * 3 // 4 if left else 0
            for j in range(t):  # the next stretch of each list, down to the limit
                stretch = self.part[place[j] : hi[j]]
                end = place[j] + int(np.searchsorted(-stretch, -(limit // weights[j]), "right"))
                doc, gain = self.doc[place[j] : end], self.part[place[j] : end] * weights[j]
                own = among[doc]
                lower[doc[own]] += gain[own]  # a list has a document once
                met[doc[own], j] = True
                place[j] = end
            ahead = np.where(place < hi, self.part[np.minimum(place, hi - 1)] * weights, 0)
            rest = int(ahead.sum())
            kth = max(1, int(np.partition(lower[live], -k)[-k])) if len(live) >= k else 1
            if rest < kth:  # nothing new can come in, so only what was met counts
                live = live[lower[live] > 0]
            # sums stay below 2**53, so doubles are exact
            upper = lower[live] + rest - (met[live] @ ahead.astype(np.float64)).astype(np.int64)
            stay = upper >= kth
            among[:] = False
            live, upper = live[stay], upper[stay]
            among[live] = True
            if (upper == lower[live]).all():
                break
        live = live[lower[live] > 0]
        top = live[np.lexsort((self.did[live], -lower[live]))[:k]]
        return self.did[top], lower[top], int((place - lo).sum())


def _search(path: str, many: int, total: int, k: int, block: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("search")
        held: list[pa.RecordBatch] = []

        def work():
            table = pa.Table.from_batches(held)
            table = table.filter(pc.greater(pc.list_value_length(table.column("term")), 0)).combine_chunks()
            if not table.num_rows:
                return
            term, tf = (table.column(c).combine_chunks() for c in ("term", "tf"))
            sizes = np.diff(term.offsets.to_numpy()).astype(np.int64)
            lists = Lists(table.column("did").to_numpy(), table.column("n").to_numpy(), sizes, term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), many, total)
            for items in _files(path):
                out = [(np.zeros(0, np.int64),) * 3]
                for iid, words, weights in zip(items.column("iid").to_pylist(), items.column("terms").combine_chunks(), items.column("weights").combine_chunks(), strict=True):
                    did, score, _ = lists.best(words.values.to_numpy().astype(np.int64), weights.values.to_numpy(), k)
                    out.append((np.full(len(did), iid), did, score))
                yield record(FOUND, (np.concatenate(c) for c in zip(*out, strict=True)))

        size = 0
        for b in it:
            held.append(b)
            size += len(b.column("term").flatten()) + b.num_rows
            if size >= block:
                yield from work()
                held, size = [], 0
        if held:
            yield from work()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, item_block: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents, ties by doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    text = lambda t: F.coalesce(t["text"].cast("string"), F.lit(""))
    asked = items.select(F.coalesce(items["item_id"].cast("long"), F.lit(LEAST)).alias("iid"), text(items).alias("text")).groupBy("iid").agg(F.min("text").alias("text"))
    asked = written(asked.select("iid", F.col("text").cast("binary").alias("text")).mapInArrow(_asked, "iid long, word long, times long"), "asked")
    path = fresh_dir(spark, "vocabulary")
    asked.select("word").distinct().write.parquet(path)
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)).alias("did"), text(docs).cast("binary").alias("text"))
    counted = written(base.mapInArrow(_count(path), COUNTED_SQL), "counted")
    many, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = (2 * F.lit(many) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = df.select("term", F.floor(1000 * F.ln(ratio)).alias("w"))
    # a word's place in the sorted vocabulary, as the tasks have it
    vocabulary = spark.read.parquet(path)
    place = numbered(vocabulary)
    terms = asked.join(place, "word").join(weights, "term").select("iid", "term", (F.col("w") * F.col("times")).alias("w"))
    packed = terms.groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x")).select("iid", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))
    asking = fresh_dir(spark, "items")
    packed.write.option("maxRecordsPerFile", item_block).parquet(asking)
    found = counted.mapInArrow(_search(asking, many, max(total, 1), k, block), FOUND_SQL)
    rank = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score"), "did"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return best.select(named("iid").alias("item_id"), "rank", named("did").alias("doc_id"), "score")


def numbered(vocabulary: DataFrame) -> DataFrame:
    """(word, term): places in ascending order, counted within ranges and carried over them."""
    ranged = written(vocabulary.repartitionByRange("word").sortWithinPartitions("word").withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each range
    first = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("first"))
    return ranged.withColumn("part", part).join(first, "part").select("word", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")).cast("int").alias("term"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return search(read("documents"), read("benchmark"))
