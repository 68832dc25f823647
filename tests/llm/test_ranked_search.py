"""Ranked search against a plain full scoring, in blocks of any size."""

import collections
import math
import re

import numpy as np
import pytest

from sparsetrack.llm import op13_ranked_search as s

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    many, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        asked = terms(text)
        scores = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * many // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in asked if w in c)
            if score > 0:
                scores.append((-score, i if i is not None else -(1 << 63), i))
        out += [(item, r, i, -v) for r, (v, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def tables(seed, docs=150, items=12):
    rng = np.random.default_rng(seed)
    word = lambda: f"W{rng.zipf(1.3) % 400}"
    d = [(i, " ".join(word() for _ in range(rng.integers(0, 60)))) for i in range(docs)]
    d += [(1000, d[3][1]), (1001, d[3][1]), (d[4][0], d[4][1]), (5, "W1 other"), (None, "W1 W2 w3"), (2000, None), (2001, "!!"), (2002, " ".join(d[5][1] for _ in range(50)))]
    q = [(i, " ".join(word() for _ in range(rng.integers(1, 30)))) for i in range(items)] + [(100, None), (101, "?!"), (102, "nowhere"), (103, d[7][1] + " " + d[7][1]), (None, "W1")]
    return d, q


@pytest.mark.parametrize("block", [1, 200, 10**6])
def test_equals_full_scoring(spark, block):
    d, q = tables(2)
    docs = spark.createDataFrame([(*r, 1) for r in d], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame(q, "item_id long, text string")
    got = [tuple(r) for r in s.search(docs, items, block=block, item_block=5).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(plain(d, q), key=str)


def test_reading_ends_early():
    """A rare word's documents and nothing else can be the best: the frequent word's list isn't read to its end."""
    n = 20_000
    did, many = np.arange(n), n
    sizes = np.ones(n, np.int64)
    sizes[:30] = 2
    term, tf = np.zeros(n + 30, np.int64), np.ones(n + 30, np.int64)
    term[1:60:2] = 1
    tf[:1030] = 50  # far larger impacts
    lengths = np.full(n, 100)
    lists = s.Lists(did, lengths, sizes, term, tf, many, int(lengths.sum()))
    found, score, read = lists.best(np.array([0, 1]), np.array([10, 9000]), 20)
    assert found.tolist() == list(range(20)) and len(set(score.tolist())) == 1
    assert read < n / 2


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert s.search(docs.limit(0), items).count() == 0
    assert s.search(docs, items.limit(0)).count() == 0


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "aa bb " * 200_000), (2, "aa cc"), (3, "dd")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "AA, bb!"), (1, "zz")], "item_id long, text string")  # the smallest text asks
    got = s.search(docs, items).collect()
    assert {r.doc_id for r in got} == {1, 2} and got[0].item_id == 1
