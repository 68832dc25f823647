"""Repeated windows against brute force: bytes (op3) and words (op7)."""

import hashlib
import random
import re

import pytest

from sparsetrack.llm import repeats, windows
from sparsetrack.llm.op3_suffix_dedup import remove_repeats
from sparsetrack.llm.op7_substring_dedup import remove_repeated_passages
from sparsetrack.llm.shared import record

SCHEMA = "doc_id long, text string, kept string, spans int"


def corpus(seed, n=40, unit=6):
    rnd = random.Random(seed)
    words = ["la", "été", "of", "the", "ñandú", "x", "Straße", "to", "y\x0bz", "q\x1cw"]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, unit)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.6 else " ".join(f"{rnd.choice(words)}{rnd.randint(0, 50)}" for _ in range(rnd.randint(1, 40))))
            if rnd.random() < 0.1:
                parts.append("ab " * rnd.randint(1, 90))
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(parts), "k", i))
    rows += [(n, None, None, None), (n + 1, "", "", 0), (n + 2, rows[0][1], "k", 1), (n + 2, rows[0][1], "k", 1), (None, rows[1][1], "n", 2), (n + 3, "é" * 120, "", 3)]
    return rows


def expected_bytes(rows, width):
    docs = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows})
    seen, out = set(), {}
    for i, text in docs:
        raw = text.encode()
        hit = [False] * len(raw)
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                hit[s : s + width] = [True] * width
            seen.add(w)
        spans = sum(1 for j in range(len(raw)) if hit[j] and (j == 0 or not hit[j - 1]))
        out[None if i == -1 else i] = (len(raw), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(raw, hit) if not h)).hexdigest())
    return out


def expected_words(rows, width):
    docs = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows})
    first, out = {}, {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), i)
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        hit = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                hit[s : s + width] = [True] * width
        out[None if i == -1 else i] = (len(w), sum(hit), hashlib.sha256(" ".join(x for x, h in zip(w, hit) if not h).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed,crowd,piece", [(1, 50_000, 1 << 20), (2, 1, 1 << 20), (3, 50_000, 700), (4, 3, 1 << 20)])
def test_bytes(spark, monkeypatch, seed, crowd, piece):
    rows = corpus(seed)
    if piece < 1 << 20:
        monkeypatch.setattr(windows.batches, "__defaults__", (piece,))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = remove_repeats(df, 100, 16, crowd).collect()
    want = expected_bytes(rows, 100)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("seed,crowd", [(1, 50_000), (2, 1), (3, 50_000), (4, 1_000), (5, 3)])
def test_words(spark, seed, crowd):
    rows = corpus(seed, unit=9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = remove_repeated_passages(df, 50, 8, crowd).collect()
    want = expected_words(rows, 50)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) == want[r.doc_id], r.doc_id


def test_pieces_agree():
    """Runs of a long document are the same, whether it is hashed whole or in pieces."""
    rnd = random.Random(5)
    v = windows.byte_values(bytes(rnd.choice(b"abc") for _ in range(5000)))
    whole = next(iter(windows.batches(iter([((0,), v)]), 100, 16, 10_000)))[1]
    parts = [r for _, r in windows.batches(iter([((0,), v)]), 100, 16, 900)]
    assert sorted(zip(whole.lo.tolist(), whole.hi.tolist(), whole.context.tolist())) == sorted(x for r in parts for x in zip(r.lo.tolist(), r.hi.tolist(), r.context.tolist()))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(df).count() == 0
    assert remove_repeated_passages(df).count() == 0


def test_different_texts_under_one_id(spark):
    a, b = "alpha " * 60, "beta " * 90
    rows = [(7, a, "", 0), (7, b, "", 0), (8, a + b, "", 0)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len(x[1]) for x in rows)


def test_whole_characters(spark):
    rows = [(1, "é" * 60, "", 0), (2, "x" + "é" * 60 + "y", "", 0)]
    got = {r.doc_id: r.clean_text for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), clean=True).collect()}
    assert got[2] == "xy"


@pytest.mark.parametrize("unit,width,k", [("bytes", 100, 16), ("words", 50, 8)])
def test_dealing_on_keeps_each_window_once(unit, width, k):
    """Pieces of a run have all its windows, once each; equal windows of two runs meet under one key in every round."""
    rnd = random.Random(7)
    sep = b"" if unit == "bytes" else b" "
    token = lambda: bytes([rnd.randrange(33, 127)]) if unit == "bytes" else b"w%d" % rnd.randrange(99)
    anchor, same = [token() for _ in range(k)], [token() for _ in range(width)]
    rows = []
    for did in range(2):
        before = [token() for _ in range(20)] + same[:10]
        rows.append((5, did, 0, 40, 30, sep.join((before + anchor + same[10:] + [token() for _ in range(10)])[: 30 + width])))
    for pieces in (repeats.PARTS, repeats.PARTS**4):
        batch = record(repeats.SLICE, zip(*rows, strict=True))
        seen, keys = {}, {}
        for out in repeats._deal(unit, width, k, pieces)(iter([batch])):
            for r in out.to_pylist():
                tokens = [bytes([c]) for c in r["tokens"]] if unit == "bytes" else r["tokens"].split()
                for s in range(len(tokens) - width + 1):
                    assert r["lo"] + s not in seen.setdefault(r["did"], set())
                    seen[r["did"]].add(r["lo"] + s)
                    assert tokens[r["at"] : r["at"] + k] == anchor
                    keys.setdefault((r["at"] - s, tuple(tokens[s : s + width])), set()).add(r["akey"])
        assert seen == {d: set(range(40, 71)) for d in range(2)}
        assert all(len(x) == 1 for x in keys.values())
