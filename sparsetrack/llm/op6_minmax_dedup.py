"""Near-duplicates by min-max hashing.

Every permutation gives two signature values, the smallest and the largest hash of a document's shingles, so half the
evaluations fill the same signature; bands of four values deal documents into buckets.  Documents with the same shingle
set are one class from the start.  In a bucket, classes are compared with its best connected member (a star, not all pairs),
which then leaves; buckets that still hold different components go through up to ``STARS`` more rounds, as long as a round,
the first too, halves the members' partners.  What is left after that is compared pair by pair.  Two bounds stand before each comparison and drop no true link:
set sizes, and the popcount of the xor of 1,024-bit parity sketches, which is never more than the symmetric difference.
Every link is confirmed on the full shingle sets; the text of a member that many are compared with is dealt out in shares.
Components are found by label propagation; no links, fingerprints or members come to the driver.

Bands have the most values at which a link at ``percent`` / 100 is missed by all with a probability below 1e-5: 24 bands of
4 at 85 (2e-8) and 80, 48 bands of 2 at 50.

Words are runs of characters other than white space ([\\x20\\x09-\\x0D]) after lower-casing A-Z.  Texts of fewer words than
``size`` have their whole word sequence as their one shingle; without words (null texts too) the set is empty and such a
document is linked with nothing.  A null doc_id comes before all others and shows as a null component_id.  Rows of one
doc_id with different texts are different documents; repeated equal rows get the same answer.  Empty tables are fine.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import LEAST, discard, enter, keyed, record, settle, written
from .windows import BASE, BASE2, BASE_INV, U, mix, prefix, span, word_hashes

SIZE, PERCENT, VALUES, SKETCH, STARS, FEW, SHARE = 5, 85, 96, 16, 4, 100, 1_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = mix(np.arange(1, VALUES // 2 + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1001, VALUES // 2 + 1001, dtype=U))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = word_hashes(text.translate(_LOWER))
    if not len(words):
        return words
    k = min(size, len(words))
    at = np.arange(len(words) - k + 1)
    return np.unique(mix(span(prefix(words, BASE), at, at + k, BASE_INV) + U(k)))


def band_rows(percent: int, miss: float = 1e-5) -> int:
    """Values to a band."""
    return max((r for r in (1, 2, 3, 4, 6, 8, 12) if (1 - (percent / 100) ** r) ** (VALUES // r) < miss), default=1)


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation, alternating; long sets piecewise."""
    low, high = np.full(len(_ADD), ~U(0)), np.zeros(len(_ADD), U)
    for at in range(0, len(s), 1 << 14):
        x = s[at : at + (1 << 14), None] * _MULTIPLY + _ADD
        low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    return np.stack((low, high), 1).ravel()


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's counts in 64 * SKETCH cells."""
    cells = np.bincount((s % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(bool), bitorder="little").view(np.int64)


SIGNED = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
SIGNED_SQL = "did long, th long, n long, f1 long, f2 long, bands array<long>, sketch array<long>"


def _sign(size: int, rows: int):
    many = VALUES // rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        for b in it:
            out = []
            for did, th, text in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text"), strict=True):
                s = shingles(text.as_py(), size)
                if not len(s):
                    out.append((did, th, 0, 0, 0, [], []))
                    continue
                values = signature(s).reshape(many, rows)
                bands = np.zeros(many, U)
                for j in range(rows):
                    bands = mix(bands * U(BASE) + values[:, j])
                bands = mix(bands + np.arange(many, dtype=U) * U(BASE2))
                f = np.array([np.bitwise_xor.reduce(mix(s + U(77))), mix(s ^ U(BASE2)).sum(dtype=U)], U).view(np.int64)
                out.append((did, th, len(s), int(f[0]), int(f[1]), bands.view(np.int64), sketch(s)))
            yield record(SIGNED, zip(*out, strict=True) if out else [[]] * len(SIGNED))

    return run


def _confirm(size: int, percent: int):
    """Pairs with both texts -> the pairs that are links; sets of recent texts are kept."""
    schema = pa.schema([("a_did", pa.int64()), ("a_th", pa.int64()), ("b_did", pa.int64()), ("b_th", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near")
        recent: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        held = 0

        def of(key, text):
            nonlocal held
            if key not in recent:
                recent[key] = shingles(text.as_py(), size)
                held += len(recent[key])
                while held > 2_000_000 and len(recent) > 1:
                    held -= len(recent.popitem(last=False)[1])
            return recent[key]

        for b in it:
            out = []
            for ad, at, bd, bt, ta, tb in zip(*(b.column(c).to_pylist() for c in schema.names), b.column("a_text"), b.column("b_text"), strict=True):
                x, y = of((bd, bt), tb), of((ad, at), ta)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((ad, at, bd, bt))
            yield record(schema, zip(*out, strict=True) if out else [[]] * 4)

    return run


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, did, th, n_shingles, component_id, kept, first (and nothing else of the input).

    ``first``: of the documents of a component that share the smallest doc_id, the one with the smallest ``th``.
    """
    spark, base = docs.sparkSession, keyed(docs)
    texts = base.select("did", "th", F.col("text").cast("binary").alias("text"))
    signed = written(texts.mapInArrow(_sign(size, band_rows(percent)), SIGNED_SQL), "signed")
    node = F.struct("did", "th")
    classes = written(signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(node).alias("node"), F.min_by(F.struct("bands", "sketch"), node).alias("x")).select("n", "f1", "f2", "node", "x.bands", "x.sketch"), "classes")
    inbucket = classes.select("node", F.explode("bands").alias("bucket"))
    several = inbucket.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = written(inbucket.join(several, "bucket"), "buckets")
    settle(spark)
    facts = classes.select("node", "n", "sketch")

    def worth(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, shares) that pass the bounds."""
        fa, fb = (facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
        return pairs.join(fa, "a").join(fb, "b").where(near()).select("a", "b", "shares")

    def near():
        sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        apart = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(SKETCH)), F.lit(0))
        return sizes & (apart * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b, shares): b's text goes to so many shares of its partners."""
        pairs = pairs.select(F.col("a.did").alias("a_did"), F.col("a.th").alias("a_th"), F.col("b.did").alias("b_did"), F.col("b.th").alias("b_th"), F.pmod(F.xxhash64("a"), "shares").alias("share"))
        a = texts.select(F.col("did").alias("a_did"), F.col("th").alias("a_th"), F.col("text").alias("a_text"))
        b = texts.select(F.col("did").alias("b_did"), F.col("th").alias("b_th"), F.col("text").alias("b_text"))
        b = pairs.select("b_did", "b_th", "share").distinct().join(b, ["b_did", "b_th"])
        found = pairs.join(a, ["a_did", "a_th"]).join(b, ["b_did", "b_th", "share"]).mapInArrow(_confirm(size, percent), "a_did long, a_th long, b_did long, b_th long")
        return found.select(F.struct(F.col("a_did").alias("did"), F.col("a_th").alias("th")).alias("a"), F.struct(F.col("b_did").alias("did"), F.col("b_th").alias("th")).alias("b")).distinct()

    partners = lambda t: t.agg(F.coalesce(F.sum(F.col("members") - 1), F.lit(0)), F.coalesce(F.avg(F.col("members") - 1), F.lit(0.0))).first()  # noqa: E731  all, and of a row on average
    rest, links, labels, before = buckets.withColumn("label", F.col("node")), None, None, partners(buckets)[0]
    for _ in range(1 + STARS):
        degree = rest.groupBy("node").agg(F.sum("members").alias("degree"))
        centres = written(rest.join(degree, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "label", "degree"), F.struct("degree", "node")).alias("c")).select("bucket", "c.*"), "centres")
        c = centres.select("bucket", F.col("node").alias("b"), F.col("label").alias("b_label"), (1 + F.floor(F.col("degree") / (SHARE * VALUES // band_rows(percent)))).alias("shares"))
        star = rest.join(c, "bucket").where((F.col("node") != F.col("b")) & (F.col("label") != F.col("b_label"))).select(F.col("node").alias("a"), "b", "shares").distinct()
        found = written(confirmed(worth(star)), "links")
        links = found if links is None else links.union(found)
        settle(spark)
        labels = components(links)
        # what a bucket still holds of different components; its centre is through with all of them
        now = rest.select("bucket", "node").join(centres.select("bucket", "node"), ["bucket", "node"], "left_anti").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        mixed = now.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("members")).where("l1 <> l2").select("bucket", "members")
        rest = written(now.join(mixed, "bucket"), "mixed")
        discard(centres)
        left, mean = partners(rest)
        if mean <= FEW or left > before / 2:
            break
        before = left
    if left:
        known = rest.join(facts, "node")
        x, y = (known.select("bucket", "members", F.col("node").alias(c), F.col("label").alias(f"l_{c}"), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
        across = x.join(y, ["bucket", "members"]).where((F.col("a") < F.col("b")) & (F.col("l_a") != F.col("l_b")) & near())
        more = written(confirmed(across.groupBy("a", "b").agg((1 + F.floor(F.max("members") / SHARE)).alias("shares"))), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    discard(buckets, rest)
    settle(spark)
    classed = signed.select("did", "th", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "node"), ["n", "f1", "f2"], "left").join(labels, "node", "left")
    smallest = F.coalesce(F.col("label.did"), F.col("node.did"), F.col("did"))
    text = F.coalesce(F.col("label.th"), F.col("node.th"), F.col("th"))
    return classed.select(
        F.when(F.col("did") != LEAST, F.col("did")).alias("doc_id"),
        "did",
        "th",
        F.col("n").alias("n_shingles"),
        F.when(smallest != LEAST, smallest).alias("component_id"),
        (F.col("did") == smallest).alias("kept"),
        ((F.col("did") == smallest) & (F.col("th") == text)).alias("first"),
    )


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at a similarity of 0.8 or more (the pipeline's own measure; the query's is 0.85): its smallest
    document; groups of one stay."""
    kept = written(near_duplicates(docs, percent=80).where("first").groupBy("did", "th").agg(F.count("*").alias("n")), "kept")
    base = keyed(docs, "lang", "source", "n_chars")
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    once = base.join(kept.where("n = 1"), ["did", "th"], "left_semi").select(*columns)
    if kept.where("n > 1").isEmpty():
        return once
    # rows with equal keys are one document
    equal = base.join(kept.where("n > 1"), ["did", "th"], "left_semi").groupBy("did", "th").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return once.unionByName(equal.select(*(F.col(f"row.{c}").alias(c) for c in columns)))
