"""Fingerprints by consistent weighted sampling, in DataFrame operations alone.

A document's terms are its words (runs of characters other than [\\x20\\x09-\\x0D], lower-cased), weighted by how often they
occur.  For sample j a term k of weight w has r, c ~ Gamma(2, 1) and b ~ U(0, 1), all drawn from hashes of (k, j);
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1).  The sample is the (k, t) of the smallest a.  Two documents agree in
a sample with a probability of sum min / sum max of their weights, the generalised Jaccard similarity, so the share of
samples in which they agree estimates it, with a standard error of at most 0.5 / sqrt(``SAMPLES``).  As a is a function of
(k, t), the smallest a stands for the sample: 32 bits of its hash are kept, as eight hexadecimal digits.

Most draws need no logarithm: as exp(-r) is a product u of two uniforms, r (t - b) <= ln w and c = -ln v >= 1 - v, a is at
least (1 - v) u / w; with a weight of 1, where t is 0, even (1 - v) times the weighted harmonic mean of 1 and u.  The smallest
a of a document of total weight W is below ``MARGIN`` / W but for a probability of exp(-MARGIN).  Draws whose bound lies above
that are passed over; a document in which a sample's smallest a isn't below it is drawn again with nothing passed over.  So no
fingerprint depends on the margin.

Null texts are empty.  A text without words has the empty word as its one term, so such texts agree with each other and with
nothing else.  The next document is that with the next larger (doc_id, hash of the text), after the last the first; a lone
document is its own next.  A null doc_id comes before all others.  Rows with one doc_id and different texts are different
documents; repeated equal rows are one document and get its result each.  Other columns of the input are left out.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LEAST, discard, settle, written

SAMPLES, MARGIN, FEW = 48, 12.0, 10_000
KEY = ["did", "th"]


def _uniform(h: str, shift: int, bits: int) -> Column:
    """Uniform in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(F.col(h), shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(2.0**-bits)


def samples(weights: DataFrame, keys: list[str], sides: list[str], count: int = SAMPLES, margin: float | None = MARGIN) -> DataFrame:
    """keys, for each side its samples (ln a, array<double>), and ``sound``.

    ``weights``: keys, ``term`` (long), a weight for each side (0: the term is not in it), ``total``: the smallest total weight
    of a side of these keys.  ``sound`` is false where draws that were passed over may have mattered.
    """
    most = F.greatest(*sides) if len(sides) > 1 else F.col(sides[0])
    logs = [F.when(F.col(s) > 0, F.ln(s)).alias(f"l_{s}") for s in sides]
    each = weights.select(*keys, "term", "total", most.alias("most"), *logs, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("j"))
    hashed = each.withColumn("x", F.xxhash64("term", "j")).withColumn("y", F.xxhash64("x"))
    # u = exp(-r) from all 64 bits of x; v = exp(-c) and b from y
    rows = hashed.withColumns({"u": _uniform("x", 0, 32) * _uniform("x", 32, 32), "v": _uniform("y", 0, 24) * _uniform("y", 24, 24), "b": _uniform("y", 48, 16)})
    if margin:
        power = F.when(F.col("most") == 1, F.col("b") * F.col("u") + 1 - F.col("b")).otherwise(F.lit(1.0))
        rows = rows.where((1 - F.col("v")) * F.col("u") * F.col("total") <= F.col("most") * margin * power)
    rows = rows.select(*keys, "total", "j", *(f"l_{s}" for s in sides), "b", (-F.ln("u")).alias("r"), F.ln(-F.ln("v")).alias("c"))
    log_a = lambda s: F.col("c") - F.col("r") * (F.floor(F.col(f"l_{s}") / F.col("r") + F.col("b")) - F.col("b") + 1)
    least = rows.groupBy(*keys, "total", "j").agg(*(F.min(log_a(s)).alias(s) for s in sides))
    whole = least.groupBy(*keys, "total").agg(F.sort_array(F.collect_list(F.struct("j", *sides))).alias("all"))
    out = whole.select(*keys, "total", *(F.col("all").getField(s).alias(s) for s in sides))
    sound = F.lit(True)
    if margin:
        below = F.lit(math.log(margin)) - F.ln("total")
        for s in sides:
            sound = sound & (F.size(s) == count) & F.forall(s, lambda x: F.coalesce(x <= below, F.lit(False)))
    return out.withColumn("sound", sound).drop("total")


def words(text: Column) -> Column:
    """Words of a text; the empty word, if there are none."""
    return F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), "[\\x20\\x09-\\x0D]+")


def term_weights(texts: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """keys, term, how often each side's text has it, and ``total``: the smaller of the sides' numbers of words."""
    split = texts.select(*keys, *(words(F.col(s)).alias(s) for s in sides))
    total = F.least(*(F.size(s) for s in sides)) if len(sides) > 1 else F.size(sides[0])
    each = split.select(*keys, total.cast("double").alias("total"), F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(s).alias("w")) for i, s in enumerate(sides)))).alias("x"))
    terms = each.select(*keys, "total", F.col("x.side").alias("side"), F.explode("x.w").alias("word")).select(*keys, "total", "side", F.xxhash64("word").alias("term"))
    return terms.groupBy(*keys, "total", "term").agg(*(F.sum((F.col("side") == i).cast("int")).cast("double").alias(s) for i, s in enumerate(sides)))


def neighbours(lengths: DataFrame) -> DataFrame:
    """For (did, th, n, copies): the same, and did, th and n of the document before (before the first: the last).

    Rows are dealt by ranges and numbered within them, so their order needs no task that holds them all.
    """
    ranged = lengths.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)  # the range; the lower bits count within it
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each range
    first = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("first"))
    ranked = placed.withColumn("part", part).join(first, "part").select(*KEY, "n", "copies", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")).alias("rank"))
    total = placed.count()
    before = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"), *(F.col(c).alias(f"p_{c}") for c in (*KEY, "n")))
    found = written(ranked.join(before, "rank").drop("rank"), "neighbours")
    discard(placed)
    return found


def fingerprints(docs: DataFrame, count: int = SAMPLES, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per document.

    The edited text is the text with its last quarter (of its code points) replaced by the beginning of the next document.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    near = neighbours(base.groupBy(*KEY).agg(F.max(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("copies")))

    def paired(base: DataFrame, near: DataFrame) -> DataFrame:
        """Texts with their edited texts; texts are dealt by their key once, beginnings go to the document before."""
        held = base.groupBy(*KEY).agg(F.first("text").alias("text")).join(near, KEY)
        heads = held.select(F.col("p_did").alias("did"), F.col("p_th").alias("th"), F.substring("text", F.lit(1), F.floor(F.col("p_n") / 4).cast("int")).alias("head"))
        edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), F.col("head"))
        return held.join(heads, KEY).select(*KEY, "n", "copies", "p_did", "p_th", "text", edited.alias("edited"))

    def signed(texts: DataFrame, margin: float | None) -> DataFrame:
        drawn = samples(term_weights(texts, KEY, ["text", "edited"]), KEY, ["text", "edited"], count, margin)
        short = lambda c: F.transform(c, lambda a: F.xxhash64(a).bitwiseAND(F.lit(0xFFFFFFFF)))
        facts = texts.select(*KEY, "n", "copies", "p_did", "p_th", F.sha2("edited", 256).alias("edited_sha256"))
        return facts.join(drawn.select(*KEY, short("text").alias("mine"), short("edited").alias("changed"), "sound"), KEY)

    found = written(signed(paired(base, near), margin), "samples")
    settle(spark)
    result, again = found.where("sound"), written(found.where(~F.col("sound")).select(*KEY), "again")
    if not again.isEmpty():
        # of all texts only theirs and the next documents' are dealt again
        following = near.join(again.toDF("p_did", "p_th"), ["p_did", "p_th"], "left_semi").select(*KEY)
        wanted = written(again.union(following).distinct(), "again")
        part = paired(base.join(wanted, KEY, "left_semi"), near.join(wanted, KEY, "left_semi"))
        result = result.unionByName(written(signed(part.join(again, KEY, "left_semi"), None), "samples"))
        discard(wanted)
        settle(spark)
    discard(again)
    following = result.select(F.col("p_did").alias("did"), F.col("p_th").alias("th"), F.col("mine").alias("next"))
    agree = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(count))
    digits = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")
    rows = result.join(following, KEY).select(
        F.when(F.col("did") != LEAST, F.col("did")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        digits("mine").alias("fingerprint"),
        digits("changed").alias("edited_fingerprint"),
        agree("mine", "changed").alias("near_edited"),
        agree("mine", "next").alias("near_next"),
        "copies",
    )
    # repeated rows: in steps, so that no array holds them all
    step = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(FEW).cast("long"))))
    return step.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("from"), F.lit(FEW))))).drop("copies", "from", "copy")


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
