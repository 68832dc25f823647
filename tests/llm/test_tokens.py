"""Token ids, shards of them (op2) and packing (op10): exact round trips."""

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparsetrack.llm import op2_sstable as sst
from sparsetrack.llm import op10_packing as packing
from sparsetrack.llm.tokenize import encoder, public_path

SCHEMA = "doc_id long, text string, start string, length string, ids int"


def plain_ids(text):
    return encoder(public_path()).whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0, max_codepoint=0x260), max_size=40))
def test_shortcut_gives_the_library_s_ids(text):
    assert np.frombuffer(encoder(public_path()).encode(text), "<u2").tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["it's we'll DON'T x_y __ _!1²½", "ΣΑΣ αυτός", "日本語 text", "á é", "<|endoftext|> </w>a", "a\x1cb\x85c\xa0d", "İıſK", "퟿\U0001f600!"])
def test_odd_texts(text):
    assert np.frombuffer(encoder(public_path()).encode(text), "<u2").tolist() == plain_ids(text)


def rows():
    rnd = random.Random(3)
    out = [(i * 3 - 40, " ".join(rnd.choice(["Alpha", "beta", "gaMMa.", "été", "42", "x!y"]) + str(rnd.randint(0, 9)) for _ in range(rnd.choice([0, 1, 30, 700, 3000]))), None, "x", 1) for i in range(60)]
    out += [(5, None, "a", None, None), (None, "no id", None, None, 2), (7, "same", "b", "c", 3), (7, "same", "b", "c", 3), (7, "other", "b", "c", 3), (1 << 62, "far", None, None, 1)]
    rnd.shuffle(out)
    return out


def test_shards_round_trip(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    manifest = sst.write_shards(df, shard=4 << 10)
    got = sst.read_shards(manifest).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == Counter((d, (*plain_ids(t or ""), 2)) for d, t, *_ in data)
    at, last = 0, None
    for r in got:
        assert r.start == at and (last is None or (r.doc_id is not None and (last is ... or r.doc_id >= last)))
        at += r.n_tokens
        last = ... if r.doc_id is None else r.doc_id
    assert manifest.count() > 3
    want = defaultdict(list)
    for d, t, *_ in data:
        want[d].append([*plain_ids(t or ""), 2])
    found = defaultdict(list)
    for r in manifest.collect():
        with sst._open(r.path, "r") as f:
            reader = sst.Reader(f)
            for d in [*want, 999_999, 12]:
                found[d] += [x.tolist() for x in reader.get(d)]
    assert {d: sorted(v) for d, v in found.items() if v} == {d: sorted(v) for d, v in want.items()}


def test_bloom_filter_excludes_most():
    out = io.BytesIO()
    w = sst.Writer(out, block=512)
    for i in range(0, 4000, 2):
        w.add(sst.key_of(i), b"ab")
    w.close()
    r = sst.Reader(out)
    assert all(r.may_have(i) for i in range(0, 4000, 2))
    assert sum(r.may_have(i) for i in range(1, 4000, 2)) < 60
    assert len(r.index) > 10 and r.count == 2000


def check_packing(got, data, width=2048):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for d, t, *_ in data:
        want[d][(*plain_ids(t or ""), 1)] += 1
    for d, texts in want.items():
        pieces = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs[d])
        for ids, n in texts.items():
            starts = sorted((s, k) for s, k, _, total in pieces if total == len(ids))
            at = 0
            for s, k in starts:
                if s == at:
                    assert pieces[(s, k, zlib.crc32(np.array(ids[s : s + k], "<u4").tobytes()), len(ids))] == n
                    at += k
            assert at == len(ids)
    assert set(docs) == set(want)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= width
    assert sorted(sequences) == list(range(len(sequences)))
    used = [sum(n for _, n in p) for p in sequences.values()]
    return sum(width - u for u in used if u & (u - 1)) / max(1, sum(used))


def test_packing(spark):
    data = rows()
    check_packing(packing.pack(spark.createDataFrame(data, SCHEMA).repartition(3)).collect(), data)


def test_packing_cuts_finer_when_one_length_is_common(spark):
    data = [(i, "a " * 1299, None, None, None) for i in range(160)]
    assert check_packing(packing.pack(spark.createDataFrame(data, SCHEMA)).collect(), data) < 0.03


def test_packing_keeps_ids(spark):
    data = [(1, "one two three", None, None, None)]
    (r,) = packing.pack(spark.createDataFrame(data, SCHEMA), keep_ids=True).collect()
    assert np.frombuffer(r.ids, "<u4").tolist() == [*plain_ids("one two three"), 1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sst.read_shards(sst.write_shards(df)).count() == 0
    assert packing.pack(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    found = Counter()
    for n, p in packing.shortest_pack_first(histogram, 64):
        assert sum(p) <= 64 and n > 0
        for length in p:
            found[length] += n
    assert found == histogram
