"""Files written by tasks equal what one writer of all rows in order makes, however the rows are cut into parts."""

import io

import numpy as np
import pytest

from sparsetrack.sources import sinks


@pytest.fixture
def steps(spark):
    """Three chromosomes, gaps here and there, rows in no order."""
    rows = [(c, i, i + 1, float(i % 7) / 3 if i % 11 else None) for c in ("a", "bé", "c") for i in range(600) if i % 97 not in (3, 4)]
    return spark.createDataFrame(rows, "chrom string, start long, end long, value double").repartition(5)


def plain(rows, kind, step, chrom_end):
    out, before = [], None
    for r in rows:
        v = "NA" if r["value"] is None else f"{r['value']:.2f}"
        if kind == "bg":
            out.append(f"{r['chrom']}\t{r['start']}\t{r['end']}\t{v}\n")
            continue
        if before != (r["chrom"], r["start"]):
            out.append(f"fixedStep chrom={r['chrom']} start={r['start'] + 1} step={step} span={step}\n" if kind == "fix" else f"variableStep chrom={r['chrom']} span={step}\n")
        out.append((f"{r['start'] + 1}\t" if kind == "var" else "") + v + "\n")
        before = (r["chrom"], chrom_end(r))
    return "".join(out)


@pytest.mark.parametrize("kind", ["bg", "var", "fix"])
@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_parts_join_without_a_seam(spark, steps, tmp_path, monkeypatch, kind, coalesce):
    """Small chunks, many parts: headers appear just where rows don't follow each other, not at the bounds of parts."""
    monkeypatch.setattr(sinks, "CHUNK", 300)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        with open(tmp_path / "x", "w", encoding="utf-8") as f:
            f.write("# head é\n")
            sinks.write_steps(steps, f, ["value"], kind, 2, ["chrom", "start"])
            f.write("# tail\n")
        stream = io.StringIO()
        sinks.write_wig(steps, stream, kind, 2)
        with open(tmp_path / "y", "w", encoding="utf-8") as f:
            sinks.write_wig(steps, f, kind, 2)
    finally:
        spark.conf.set(name, was)
    want = plain(sorted(steps.collect(), key=lambda r: (r["chrom"], r["start"])), kind, 1, lambda r: r["end"])
    assert (tmp_path / "x").read_text(encoding="utf-8") == "# head é\n" + want + "# tail\n"
    assert stream.getvalue() == want == (tmp_path / "y").read_text(encoding="utf-8")


def test_table_words_and_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "CHUNK", 50)
    words = spark.createDataFrame([("c", i * 1000, i * 1000 + 130, "ab" * 65) for i in range(20)], "chrom string, start long, end long, word string").repartition(4)
    lines = spark.createDataFrame([(r, i, f"n{r}", float(i)) for r in range(9) for i in range(5)], "row_id long, idx long, name string, value double").repartition(4)
    table = spark.createDataFrame([(i, None if i % 3 else "xé", [1.0, None, float(i)]) for i in range(50)], "i long, s string, v array<double>").repartition(4)
    with open(tmp_path / "w", "w", encoding="utf-8") as f:
        sinks.write_words(words, f)
        sinks.write_listed(lines, f, 1)
        sinks.write_table(table, f, ["i", "s", "v", "i"], 1, ["i"], header=True)
    want = "".join(f">c:{i * 1000}-{i * 1000 + 130}\n" + "ab" * 30 + "\n" + "ab" * 30 + "\n" + "ab" * 5 + "\n" for i in range(20))
    want += "".join(f"# n{r}\n" + "".join(f"{i:.1f}\n" for i in range(5)) for r in range(9))
    want += "#i\ts\tv\ti\n" + "".join(f"{i}\t{'NA' if i % 3 else 'xé'}\t1.0,NA,{i:.1f}\t{i}\n" for i in range(50))
    assert (tmp_path / "w").read_text(encoding="utf-8") == want


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "chrom string, start long, end long, value double")
    with open(tmp_path / "e", "w", encoding="utf-8") as f:
        sinks.write_wig(none, f)
        sinks.write_table(none, f, ["chrom"], order=["chrom"])
    assert (tmp_path / "e").read_bytes() == b""
    sinks.write_matrix(spark.createDataFrame([], "row_id long, values array<double>, chrom string"), str(tmp_path / "m"), labels=True)
    assert sinks.read_matrix(str(tmp_path / "m")).size == 0


def test_matrix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "CHUNK", 100)
    rows = [(i, [float(i), None, i / 7], f"chr{i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, values array<double>, chrom string, start long").repartition(6)
    sinks.write_matrix(df, str(tmp_path / "m"), labels=True)
    back = sinks.read_matrix(str(tmp_path / "m"))
    assert np.array_equal(back, np.array([[np.nan if x is None else x for x in r[1]] for r in rows]), equal_nan=True)
    raw = (tmp_path / "m").read_bytes()
    at = int.from_bytes(raw[64:72], "little")
    assert at % sinks.ALIGN == 0 and raw[at:].decode() == "".join(f"chr{i}\t{i}\n" for i in range(500))
