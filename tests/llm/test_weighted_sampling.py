"""Consistent weighted sampling against a plain model of the draws, true similarities and edited texts."""

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

from sparsetrack.llm import op12_weighted_sampling as w

SCHEMA = "doc_id long, text string, copies int, side string"


def draws(word, weight, j):
    h = lambda v, seed: xxhash.xxh64_intdigest(v, seed=seed)
    term = h(word.encode(), 42)
    x = h(j.to_bytes(4, "little"), h(term.to_bytes(8, "little"), 42))
    y = h(x.to_bytes(8, "little"), 42)
    u = lambda v, at, bits: ((v >> at & (1 << bits) - 1) + 0.5) / 2**bits
    r, c, b = -math.log(u(x, 0, 32) * u(x, 32, 32)), -math.log(u(y, 0, 24) * u(y, 24, 24)), u(y, 48, 16)
    return math.log(c) - r * (math.floor(math.log(weight) / r + b) - b + 1)


def counts(text):
    return collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", text.lower()) or [""])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{v}" for v in rng.zipf(1.4, rng.integers(1, 150)) if v < 300) for _ in range(n)]


def test_samples_follow_the_model_whatever_is_passed_over(spark):
    rows = [(i, t, 0, "") for i, t in enumerate([*texts(30), "", "  \n ", "one", "One ONE two"])]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = df.selectExpr("doc_id", "coalesce(text, '') as text")
    weights = w.term_weights(keys, ["doc_id"], ["text"])
    plain = {r.doc_id: r.text for r in w.samples(weights, ["doc_id"], ["text"], 16, None).collect()}
    for i, t, *_ in rows:
        want = [min(draws(word, n, j) for word, n in counts(t).items()) for j in range(16)]
        assert np.allclose(plain[i], want, rtol=1e-12, atol=1e-12)
    bounded = w.samples(weights, ["doc_id"], ["text"], 16, 6.0).collect()
    assert all(r.text == plain[r.doc_id] for r in bounded if r.sound) and sum(r.sound for r in bounded) > 20
    assert not all(r.sound for r in w.samples(weights, ["doc_id"], ["text"], 16, 0.5).collect())


def test_redrawn_documents_are_the_same(spark):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts(20))], SCHEMA)
    assert sorted(w.fingerprints(df, 16, 0.5).collect()) == sorted(w.fingerprints(df, 16, 30.0).collect())


def test_likeness_estimates_generalised_jaccard(spark):
    plain = [*texts(120, seed=5), "Ünïcödé wörds ✓ über"]
    rows = w.fingerprints(spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(plain)], SCHEMA), 64).collect()
    off = []
    for r in rows:
        t, following = plain[r.doc_id], plain[(r.doc_id + 1) % len(plain)]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * 64
        off += [r.near_edited - jaccard(counts(t), counts(edited)), r.near_next - jaccard(counts(t), counts(following))]
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.08


def test_nulls_repeats_and_order(spark):
    rows = [(3, "c d", 1, "x"), (None, "zero", 1, "x"), (1, None, 1, "x"), (2, "", 1, "x"), (5, "same", 1, "x"), (5, "same", 2, "y"), (5, "other", 1, "x"), (9, "c d", 1, "x")]
    got = w.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 5), (True, 5), (True, 5), (True, 9)]
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0 and by[2][0].near_next == 0.0
    assert by[3][0].fingerprint == by[9][0].fingerprint
    assert by[9][0].edited_sha256 == hashlib.sha256(b"c d").hexdigest()
    assert sorted(collections.Counter(r.fingerprint for r in by[5]).values()) == [1, 2]
    assert w.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = w.fingerprints(spark.createDataFrame([(1, "only one here", 1, "")], SCHEMA)).collect()
    assert alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"only one honl").hexdigest()


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    got = w.fingerprints(spark.createDataFrame([(1, long, 0, ""), (2, "short", 0, ""), (3, long, 0, "")], SCHEMA)).collect()
    assert len({r.fingerprint for r in got if r.doc_id != 2}) == 1


def test_a_redraw_deals_only_the_texts_it_needs(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, " ".join(f"w{v:x}" for v in rng.integers(0, 10**9, 400)), 0, "") for i in range(200)], SCHEMA)
    sc = spark.sparkContext._jsc.sc()

    def dealt(margin):
        bytes_ = lambda: sc.listenerBus().waitUntilEmpty(30_000) or sc.statusStore().executorList(True).apply(0).totalShuffleWrite()
        at, rows = bytes_(), sorted(w.fingerprints(df, 8, margin).collect())
        return bytes_() - at, rows

    (plain, rows), (again, same) = dealt(30.0), dealt(6.0)  # nothing drawn again; some of the documents
    assert rows == same
    assert plain > 500_000 and again < 1.5 * plain
