"""The registered queries at sf0.01: columns, types, and rows against SQL, brute force or what was put in."""

import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from sparsetrack.llm import entries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    got = entries.queries()[name](spark, SF)
    want = duck.execute(entries.oracle_sql()[name]).fetchdf()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))


def ids_of(duck):
    from tokenizers import Tokenizer

    from sparsetrack.llm.tokenize import public_path

    whole = Tokenizer.from_file(public_path())
    rows = duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()
    return {i: e.ids for (i, _), e in zip(rows, whole.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_sstable(spark, duck):
    got = entries.queries()["op2_sstable"](spark, SF)
    assert dict(got.dtypes) | {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"} == dict(got.dtypes)
    at, want = 0, []
    for i, ids in ids_of(duck).items():
        want.append((i, at, len(ids) + 1, digest([*ids, 2])))
        at += len(ids) + 1
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_packing(spark, duck):
    got = entries.queries()["op10_packing"](spark, SF)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for c, t in got.dtypes if c in columns} == {"bigint"}
    pieces, sequences, want = {}, {}, {i: [*ids, 1] for i, ids in ids_of(duck).items()}
    for r in got.select(*columns).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == digest(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    used = padded = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        used, padded = used + at, padded + (2048 - at if at & (at - 1) else 0)
    assert padded <= 0.01 * (used + padded)


def test_neighbours(spark, duck):
    rows = duck.execute("select vec_id, embedding from embeddings where embedding is not null order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = entries.queries()["op5_collision_search"](spark, SF)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found, hits = {}, 0
    for r in got.collect():
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(ids[ids % 100 == 0].tolist())
    for q, mine in found.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - d[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(found)


def blocks_of(page):
    """The article's blocks, by its known marks: headings and paragraphs, with line breaks and inline marks inside."""
    inner = page[page.find("<article>") + 9 : page.rfind("</article>")]
    parts = re.sub(r"</?(p|h1)[^>]*>", "\0", inner).split("\0")
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " ")))).strip() for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_pages(spark, duck):
    want = {i: (u, blocks_of(h)) for i, u, h in duck.execute("select page_id, url, html from pages").fetchall()}
    got = entries.queries()["op9_html_extraction"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)
