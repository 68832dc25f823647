"""Options and helpers of the command line that no other test meets."""

import pytest

from sparsetrack import __version__, cli
from sparsetrack.operators import filters, profiles
from sparsetrack.sources import bigwig, text

REGIONS = "chrom string, start long, end long, row_id long"


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "x.bg").write_text("".join(f"chr\t{i}\t{i + 1}\t{i % 4}\n" for i in range(40)))
    return lambda line: cli.main(line.replace("@", f"{tmp_path}/").split(), spark=spark) or (tmp_path / "out").read_text().splitlines()


def test_version(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"], spark=object())
    assert e.value.code == 0 and __version__ in capsys.readouterr().out


def test_part_of_a_file(run):
    assert run("find more 2 @x.bg:chr:8-17 @out") == ["chr\t11\t12", "chr\t15\t16"]
    assert run("find not 3 @x.bg:chr:0-9 @out") == ["chr\t0\t3", "chr\t4\t7", "chr\t8\t9"]


def test_text_instead_of_binary(run, spark, tmp_path):
    run("remove less 2 @x.bg @out -wig-only -wigtype=bg")
    plain = (tmp_path / "out").read_text()
    cli.main(f"remove less 2 {tmp_path}/x.bg {tmp_path}/out.bw -wig-only -wigtype=bg".split(), spark=spark)
    assert (tmp_path / "out.bw").read_text() == plain
    cli.main(f"remove less 2 {tmp_path}/x.bg {tmp_path}/out2.bw".split(), spark=spark)
    back = bigwig.read_bigwig(spark, f"file://{tmp_path}/out2.bw")  # by a path with a scheme
    assert back.count() == 20 and {r.value for r in back.collect()} == {2.0, 3.0}


def test_misspelt_options(run, capsys):
    assert run("find more 2 @x.bg:chr:0-8 @out -min-seq=10") == ["chr\t3\t4", "chr\t7\t8"]
    assert "-min-seq=10" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        run("find more 2 @x.bg @out -min-seq=10 -strict")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_lists_of_files(tmp_path, scheme):
    for n in "ab":
        (tmp_path / f"{n}.bw").write_text("")
    at = f"{scheme}{tmp_path}"
    (tmp_path / "files.txt").write_text(f"{at}/a.bw first\n\n{at}/gone.bw x\n{at}/b.bw\n")
    both = [("first", f"{at}/a.bw"), (f"{at}/b.bw", f"{at}/b.bw")]
    assert text.labelled_files(f"{at}/files.txt") == both
    assert text.labelled_files(f"{at}/files.txt", 1) == both[1:]
    assert text.labelled_files("p.bw,q.bw") == [("p.bw", "p.bw"), ("q.bw", "q.bw")]


def test_mean_length(spark):
    assert profiles.mean_length(spark.createDataFrame([("a", 0, 10, 1), ("a", 5, 8, 2), ("b", 0, 8, 3)], REGIONS)) == 7
    assert profiles.mean_length(spark.createDataFrame([], REGIONS)) == 0


def test_find_not(spark):
    signal = spark.createDataFrame([("a", 0, 2, 1.0), ("a", 2, 5, 4.0), ("a", 5, 6, 1.0), ("a", 9, 10, 2.0)], "chrom string, start long, end long, value double")
    assert sorted(map(tuple, filters.find_threshold(signal, "not", 4).collect())) == [("a", 0, 2), ("a", 5, 6), ("a", 9, 10)]


def test_clusters_are_the_nearest(spark):
    """Every row has the label of the centre nearest to it, and its distance."""
    rng = __import__("random").Random(3)
    rows = [(str(i), [rng.gauss(8 * (i % 3), 1) for _ in range(4)]) for i in range(60)]
    found, centres = profiles.cluster(spark.createDataFrame(rows, "row_id string, values array<double>"), 3)
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) ** 0.5
    vectors = dict(rows)
    got = found.collect()
    assert len(got) == 60 and len({r.label for r in got}) == 3
    nearest = {r.row_id: min(range(3), key=lambda j: far(vectors[r.row_id], list(centres[j]))) for r in got}
    # labels may be numbered otherwise than the centres, but one for one
    assert len({(r.label, nearest[r.row_id]) for r in got}) == 3
