"""Stages of the pipeline against plain Python."""

from sparsetrack.llm import op1_toxicity, op3_suffix_dedup, op8_decontaminate
from sparsetrack.llm import op6_minmax_dedup as near

from test_models import teaching

ROW = "doc_id long, text string, lang string, source string, n_chars int"
TEXT = " ".join(f"word{i}" for i in range(60))


def plain_near(rows, percent=80):
    """One row of each group: groups by links over all pairs, equal (doc_id, text) are one document."""
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = [shingles(d[2]) for d in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [[docs[i][:2] for i in range(len(docs)) if label[i] == g] for g in sorted(set(label))]


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    rows = [(1, TEXT), (1, TEXT), (1, TEXT + " more"), (2, TEXT), (3, "quite another text of seven words here"), (3, "a third one, not like the other at all"), (4, ""), (4, ""), (5, None), (None, TEXT + " end"), (None, "only null has this text and no other"), (6, "single")]
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], ROW)
    got = near.stage(spark, df, "").collect()
    want = sorted(g[0] for g in plain_near(rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == want
    assert all(tuple(r)[:2] in {(i, t or "") for i, t in rows} and r.n_chars == len(r.text) for r in got)


def test_near_duplicate_stage_without_rows(spark):
    assert near.stage(spark, spark.createDataFrame([], ROW), "").count() == 0


def test_toxicity_stage_rejects_toxic_rows_only(spark, tmp_path):
    docs, labels = teaching(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(r.doc_id, r.text, "en", None, len(r.text)) for r in docs.collect()] + [(None, None, None, "s", None), (900, "", "en", "s", 0), (901, "past idle mills", "en", "s", 15), (901, "past idle mills", "en", "s", 15)]
    got = op1_toxicity.stage(spark, spark.createDataFrame(rows, ROW), str(tmp_path)).collect()
    want = [r for r in rows if not {"idiot", "loser", "stupid"} & set((r[1] or "").split())]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_cutting_stages_carry_rows(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "one short text", "en", None, 14), (None, None, None, "s", None), (3, f"before {item} after", "fr", "t", 0)]
    df = spark.createDataFrame(rows, ROW)
    for stage, third in ((op3_suffix_dedup.stage, rows[2][1]), (op8_decontaminate.stage, None)):
        got = {r.doc_id: r for r in stage(spark, df, str(tmp_path)).collect()}
        assert len(got) == 3 and tuple(got[1])[1:4] == rows[0][1:4] and (got[None].text or "") == "" and got[None].source == "s"
        assert all(r.n_chars == len(r.text or "") for r in got.values()) and (got[3].lang, got[3].source) == ("fr", "t")
        assert got[3].text == third if third else "item5" not in got[3].text and "before" in got[3].text
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_whole_pipeline(spark, tmp_path):
    import corpus_pipeline
    from sparsetrack.llm.tokenize import encoder, public_path

    docs, labels = teaching(spark)
    item = " ".join(f"item{i}" for i in range(40))
    rows = [(r.doc_id, r.text, "en", None, len(r.text)) for r in docs.collect()]
    rows += [(900, TEXT, "en", "s", 0), (901, TEXT + " tail", "en", "s", 0), (902, None, None, None, None), (903, f"start {item} end", "fr", "t", 0)]
    spark.createDataFrame(rows, ROW).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = [r for r in rows if not {"idiot", "loser", "stupid"} & set((r[1] or "").split())]
    assert {r.doc_id for r in got} == {g[0][1] for g in plain_near(clean)}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(pieces[r.doc_id]) == r.doc_tokens for r in got)
    for at in sequences.values():
        assert sorted(at) == [(sum(n for _, n in sorted(at)[:i]), n) for i, (_, n) in enumerate(sorted(at))]
    assert {r.doc_tokens for r in got if r.doc_id == 903} == {len(encoder(public_path()).encode("start  end")) // 2 + 1}
    (tmp_path / "none").mkdir()
    for name, kind in (("documents", ROW), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
