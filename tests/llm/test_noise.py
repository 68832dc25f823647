"""Noise that the lattice of operator 1 reads: doubled letters, long words, wide gaps."""

import pytest

from sparsetrack.llm import op1_toxicity as tox

from test_models import teaching

NOISY = [
    "over the stuupid boat",
    "small iddiot river",
    "towns iiddiioott",
    "the stu" + "p" * 70 + "id ran",
    "the " + "-".join(["i.d.i.o.t"] * 12) + " ran",
    "small s  t  u  p  i  d river",
    "small s\nt\nu\np\ni\nd river",
    "small s\u00a0t\u00a0u\u00a0p\u00a0i\u00a0d river",
    "i d i o t  l o s e r",
    "l o s e r\ni d i o t",
]
PLAIN = ["the small hills and mills", "aa bb cc", "past  idle   mills", "t h e  r i v e r  r a n"]


def test_more_noise_is_undone(spark):
    docs, labels = teaching(spark)
    rows = list(enumerate(NOISY + PLAIN))
    got = tox.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels, teaching=docs).collect()
    wrong = [rows[r.doc_id] for r in got if r.predicted != int(r.doc_id < len(NOISY))]
    assert len(got) == len(rows) and not wrong


def test_long_words_are_read_whole(spark):
    docs, _ = teaching(spark)
    model = tox.character_model(docs)
    for word in ("s.t.u.p.i.d", "1d10t", "l0$er"):
        one = tox.decode(word, model)
        many = tox.decode(" ".join([word] * 400), model)
        assert many.replace(" ", "").count(one) == 400


@pytest.mark.parametrize(
    "text, runs",
    [
        ("a b c d", ["a b c d"]),
        ("a\tb  c d", ["a b c d", "a b", "c d"]),
        ("a b c  d e f", ["a b c d e f", "a b c", "d e f"]),
        ("a b c\nd e f", ["a b c d e f", "a b c", "d e f"]),
        ("a  b  c   d  e  f", ["a b c d e f", "a b c", "d e f"]),
        ("ab c d", []),
    ],
)
def test_runs_of_single_letters(text, runs):
    assert tox._runs(text) == runs
