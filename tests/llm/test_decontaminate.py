"""The FM-index search (op8) against brute force."""

import random
import re

import numpy as np
import pytest

from sparsetrack.llm.op8_decontaminate import FMIndex, decontaminate, suffix_array, words_of

SCHEMA = "doc_id long, text string, items string, spans int"
PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, names = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit[s : s + n] = [True] * n
                    names |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), sum(hit), sorted(x for x in names if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,shard,block", [(1, 400_000, 4 << 20), (2, 300, 200), (3, 50, 1), (4, 12, 300)])
def test_against_brute_force(spark, seed, shard, block):
    rnd = random.Random(seed)
    vocabulary = ["a", "été", "Zwei", "b3", "x-y", "ñ!", "LA"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(rnd.randint(0, 30))) for i in range(25)] + [("0", "a b3"), (None, text(12)), ("e", None), ("f", "..."), ("b", "b3 zwei a Zwei b3")]
    docs = [(i, text(rnd.randint(0, 40)) + " ".join(rnd.choice(items)[1] or "" for _ in range(rnd.randint(0, 3)))) for i in range(60)] + [(60, None), (61, ""), (None, items[3][1]), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(df, bench, shard_words=shard, block_bytes=block).collect()]
    assert sorted(got, key=repr) == brute(docs, items)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate(none, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b", "", 0)], SCHEMA)
    assert [(r.n_words, r.n_hit) for r in decontaminate(docs, bench).collect()] == [(2, 0)]


def test_clean_text(spark):
    docs = spark.createDataFrame([(1, "Keep this, ONE two-three; and that.", "c", 5)], SCHEMA)
    bench = spark.createDataFrame([(9, "one two three")], "item_id int, text string")
    (r,) = decontaminate(docs, bench, carry=("items",) and (), clean=True).collect()
    assert r.clean_text == "Keep this, ; and that." and list(r["items"]) == ["9"]


def test_suffix_array():
    rnd = np.random.default_rng(1)
    x = np.append(rnd.integers(1, 3, 300), 0)
    assert suffix_array(x).tolist() == sorted(range(301), key=lambda i: x[i:].tolist())


def test_located_places():
    docs = [words_of(t)[0] for t in (b"a b a b a", b"", b"b a b", b"a b a b a")]
    index = FMIndex(docs)
    lo, hi = index.search(index.symbols(words_of(b"a b")[0]), np.array([0]), 2)
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == [0, 2, 8, 11, 13]


def test_a_benchmark_takes_little_memory():
    """Under 100 MB a worker for a benchmark of the broadcast limit and four times as much."""
    import tracemalloc

    from sparsetrack.llm.op8_decontaminate import BLOCK_BYTES, Phrases

    rnd = np.random.default_rng(3)
    items = [(str(i), " ".join(f"w{x}" for x in rnd.integers(0, 10_000, 200))) for i in range(4 * BLOCK_BYTES // 1200)]
    tracemalloc.start()
    phrases = Phrases(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(phrases.groups) == 1


def test_a_very_long_document(spark):
    """Longer than a shard; hits at the seams of its pieces."""
    item = [f"i{j}" for j in range(12)]
    text = [f"w{j % 977}" for j in range(30_000)]
    for at in (0, 991, 1000, 15_995, 29_988):
        text[at : at + 12] = item
    docs = spark.createDataFrame([(1, " ".join(text), "", 0), (2, None, "", 0)], SCHEMA)
    bench = spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate(docs, bench, shard_words=1000).collect()}
    covered = {at + j for at in (0, 991, 1000, 15_995, 29_988) for j in range(12) if text[at + j] == item[j]}
    assert (got[1].n_words, got[2].n_words, list(got[1]["items"])) == (30_000, 0, ["a"])
    want = brute([(1, " ".join(text))], [("a", " ".join(item))])[0]
    assert got[1].n_hit == want[2] and want[2] <= len(covered)
