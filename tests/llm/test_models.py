"""Held-out accuracy (op1, op4), recall (op5) and exact texts (op9)."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparsetrack.llm import op1_toxicity as tox
from sparsetrack.llm import op4_kneser_ney as kn
from sparsetrack.llm import op5_collision_search as ann
from sparsetrack.llm import op9_html_extraction as html

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")


@needs_data
def test_toxicity_held_out(spark):
    got = tox.op1_toxicity(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 50 and not [r for r in rows if r.predicted > r.toxic]


@pytest.mark.skipif(not os.path.exists(LARGER), reason="no test tables")
def test_toxicity_recall_and_precision(spark):
    """Six of the 97 held-out toxic rows hold no toxic word (junk text under a toxic label), so recall can't pass 0.94."""
    got = tox.op1_toxicity(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id")
    rows = got.where("held_out and toxic in (0, 1)").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.98 * sum(r.predicted for r in rows)


def teaching(spark):
    rnd = random.Random(4)
    clean = "the river ran over stones and the small boat went on past idle mills toward lost towns".split()
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(clean) for _ in range(rnd.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "loser", "stupid"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_noise_is_undone(spark):
    docs, labels = teaching(spark)
    noisy = ["over the 1d10t boat", "small s t u p i d river", "towns l0$er", "stuuuupid boat", "the i.d.i.o.t ran", "past mills", "", None, "the river ran over " * 4000]
    test = spark.createDataFrame([(i, t, "score", 0.5) for i, t in enumerate(noisy)] + [(None, "idiot", None, None), (3, "idiot", None, None), (3, "idiot", None, None)], "doc_id long, text string, lang string, score double")
    got = tox.toxicity(test, labels, teaching=docs).collect()
    assert [r.predicted for r in sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 12


def test_toxicity_without_labels(spark):
    docs, labels = teaching(spark)
    assert {r.score for r in tox.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert tox.toxicity(docs.limit(0), labels).count() == 0


def reference_model(texts, order=5):
    """Interpolated modified Kneser-Ney, written plainly."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        x = [0] * (order - 1) + kn.symbols_of(t).tolist()
        for i in range(order - 1, len(x)):
            grams[order][tuple(x[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    discounts, contexts = {}, {}
    for k in range(1, order + 1):
        n = [sum(1 for v in grams[k].values() if v == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        discounts[k] = [0.0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, c in grams[k].items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][1] += discounts[k][min(c, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        total, off = contexts[k].get(g[:-1], (0, 0.0))
        if not total:
            return p(g[1:])
        c = grams[k].get(g, 0)
        return (c - discounts[k][min(c, 3)] if c else 0) / total + off / total * p(g[1:])

    def logp(t):
        x = [0] * (order - 1) + kn.symbols_of(t).tolist()
        return sum(math.log(p(tuple(x[i - order + 1 : i + 1]))) for i in range(order - 1, len(x)))

    return logp


@pytest.mark.parametrize("shard_rows", [4_000_000, 200])
def test_kneser_ney_against_plain_model(spark, shard_rows):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(["ab", "abba", "Zoé", "x!", "barbara", "ñ日"]) for _ in range(n))
    trusted = [text(40) for _ in range(12)]
    model = kn.train(spark.createDataFrame([("xx", t) for t in trusted], "lang string, text string"))
    test = [text(20), "qqq zz", "", None, text(3) + "Q" + text(3), "ab ab", "ab ab"]
    rows = kn.perplexity(spark.createDataFrame([(i, t, "xx", 0.0) for i, t in enumerate(test)] + [(99, "ab", "yy", 1.0)], "doc_id long, text string, lang string, logp double"), model, shard_rows).collect()
    want = reference_model(trusted)
    assert len(rows) == len(test) + 1
    for r in rows:
        if r.doc_id == 99:
            assert r.logp is None
        else:
            assert r.logp == pytest.approx(want(test[r.doc_id] or ""), abs=1e-6)


@needs_data
def test_quality_keeps_good_documents(spark):
    got = kn.op4_kneser_ney(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 1").collect()
    good, bad = ([r.keep for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.4


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((900, 24))
    x[700:] = x[:200] + 0.01 * rnd.standard_normal((200, 24))
    x[650:690] = x[0]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(1000, None, 1.0), (1001, [0.0] * 24, 1.0), (1002, [float("nan")] * 24, 1.0), (1003, [1.0] * 3, 1.0), (1004, [], 1.0), (None, x[0].tolist(), 1.0), (1005, [None] * 24, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(3)
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), block=250, query_block=4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        rs = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in rs)
        assert [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)
        hits += len({r.vec_id for r in rs} & set(want.tolist()))
        total += 10
    assert hits / total >= 0.9
    assert set(by) == set(range(0, 900, 100))  # unusable queries have no rows


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(df, df).count() == 0


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b> text&hellip; and enough words to be content.
<p>Second one &lt;here&gt;<br>after a break, again with plenty of words in it.<div class="ad">Buy now</div><ul><li>Point one<li>Point two</ul>
<p>Ok.</p><form><input><button>Send</button></form></article><aside>Side words that are long enough to look like content.</aside>
<section id="comments"><p>A reader's remark that is fairly long and should not be here.</p></section><footer>&copy; us</footer></body></html>"""


def test_page():
    assert html.main_text(PAGE) == "\n\n".join(["A title & more", "First paragraph with bold text… and enough words to be content.", "Second one <here> after a break, again with plenty of words in it.", "Point one", "Point two", "Ok."])


def test_page_without_article():
    body = "".join(f"<p>Paragraph {i} of a text that goes on for quite a while without any tags in it.</p>" for i in range(6))
    assert html.main_text(f"<body><div id=menu><a href=x>a</a></div><div><div class=text>{body}</div></div><div class=sidebar>Ads</div>").count("Paragraph") == 6


def test_pages_table(spark):
    rows = [(1, "u", None, "t"), (2, None, "", None), (3, "u", PAGE, "t"), (3, "u", PAGE, "t"), (None, "u", "<p>Just this", "t"), (5, "u", "<<<>&#xD800;", "t"), (6, "u", "<p>" + "word " * 200_000, "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[None] == "Just this"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_other_scripts_have_a_perplexity_of_their_own(spark):
    """Text of the trusted kind is likelier than shuffled letters of the same script."""
    rnd = random.Random(8)
    for words in ("привет мир река дом вода лодка город старый", "日本 東京 大阪 京都 名古屋 札幌 横浜 神戸"):
        words = words.split()
        text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
        odd = "".join(rnd.choice("".join(words)) for _ in range(120))
        docs = [(i, "x", text(40)) for i in range(60)] + [(100, "x", text(40)), (101, "x", odd)]
        df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
        labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
        got = {r.doc_id: r.perplexity for r in kn.quality(df, labels).where("doc_id >= 100").collect()}
        assert got[101] > 5 * got[100] > 5


def test_quality_without_labels_and_languages(spark):
    docs = spark.createDataFrame([(1, None, "some text"), (1, None, "some text"), (None, "x", "a"), (2, "x", None), (3, "y", "other")], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = kn.quality(docs, none).collect()
    assert len(got) == 5 and all(r.keep for r in got) and {r.threshold for r in got} == {None}
    assert kn.quality(docs.limit(0), none).count() == 0
    # ties: all trusted texts alike, so the threshold is their perplexity, and they stay
    same = spark.createDataFrame([(i, None, "the same words") for i in range(40)] + [(99, None, "zzzz qqqq")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in kn.quality(same, labels).collect()}
    assert not got.pop(99) and all(got.values()) and len(got) == 40
