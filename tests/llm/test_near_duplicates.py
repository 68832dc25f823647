"""Min-max near-duplicates (op6) against all pairs."""

import random
import re

import pytest

from sparsetrack.llm.components import components
from sparsetrack.llm import components as joined
from sparsetrack.llm import op6_minmax_dedup as near
from sparsetrack.llm.op6_minmax_dedup import near_duplicates

SCHEMA = "doc_id long, text string, n string, label int"


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    docs = sorted({(-1 if d is None else d, t or "") for d, t, *_ in rows})
    s = [sets(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {(None if docs[i][0] == -1 else docs[i][0], len(s[i])): None if docs[find(i)][0] == -1 else docs[find(i)][0] for i in range(len(docs))}


@pytest.mark.parametrize("seed,percent,few", [(1, 85, 16), (2, 80, 0), (3, 50, 16)])
def test_against_all_pairs(spark, monkeypatch, seed, percent, few):
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "SHARE", 3)
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha Beta gamma été ñu x1 zz of the to".split()) + str(rnd.randint(0, 99))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([1, 4, 5, 60, 300]))]
        for _ in range(rnd.randint(1, 12)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5, 9])):
                w[rnd.randrange(len(w))] = word()
            rows.append((i, (rnd.choice(" \n\t").join(w)).upper() if rnd.random() < 0.2 else " ".join(w), "n", 1))
            i += 1
    rows += [(i, None, None, None), (i + 1, "", "", 0), (i + 2, " \n ", "", 0), (None, rows[0][1], "", 0), (i + 3, rows[5][1], "", 0), (i + 3, rows[5][1], "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = near_duplicates(df, percent=percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[(r.doc_id, r.n_shingles)], r
        assert r.kept == (r.doc_id == r.component_id)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_bands_follow_the_similarity():
    for percent in range(30, 101, 5):
        r = near.band_rows(percent)
        assert near.VALUES % r == 0 and (1 - (percent / 100) ** r) ** (near.VALUES // r) < 1e-5
    assert near.band_rows(85) == near.band_rows(80) == 4


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 5003}x{i // 700}" for i in range(40_000))
    rows = [(1, long, "", 0), (2, long + " and more", "", 0), (3, long[: len(long) // 2], "", 0)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_few_links_make_few_files(spark, monkeypatch):
    held, files = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, []
    before = {k: spark.conf.get(k) for k in held}

    def counted(df, name, write=joined.written):
        out = write(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(joined, "written", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.node: r.label for r in components(spark.createDataFrame([(i, i // 7 * 7) for i in range(1500)], "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 7 * 7 for i in range(1500) if i // 7 * 7 + 1 < 1500}
    assert max(files) <= joined.LEAST_PARTS


def test_alike_but_not_linked_texts_go_through_one_star(spark, monkeypatch):
    monkeypatch.setattr(near, "FEW", 3)
    rnd, names = random.Random(8), []
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in rnd.sample(range(300), 4):
            w[at] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "", 0))
    rows += [(40, rows[3][1] + " more", "", 0), (41, rows[17][1] + " and more", "", 0)]

    def named(df, name, write=near.written):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(near, "written", named)
    want = brute(rows, 85)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.component_id == want[(r.doc_id, r.n_shingles)] for r in got) and len(got) == 42
    assert len({r.component_id for r in got}) > 20
    assert names.count("centres") == 1
