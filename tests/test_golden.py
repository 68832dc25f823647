"""The command line on the small signals whose texts are known: 36 commands, byte for byte.

Two texts of the collection contradict its own rules and are held to the rules here: a shift of 3 moves data to higher places,
and a mask takes only what lies in it (so base 35 stays).
"""

import pytest

from sparsetrack import cli

# The two signals, base by base.
MAIN = [1, 2, 5, 6, 5, 3, 3, 5, 5, 5, 6, 6, 0, 2, 3, 3, 10, 4, 4, 2, 2, 2, 1, None, None, None, None, 2, 3, 4, 6, 6, 4, 4, 4, 2]
SECOND = [4, 2, 3, 4, 4, 3, 3, 7, 8, 7, 7, 5, 1, 2, 3, 3, 4, 4, 4, 2, 2, 2, 1, 1, 1, 2, 1, 2, 3, 4, 4, 2, 2, 2, 2, 2]
FILES = {
    "agg1.bed": "chr\t0\t4\tR1\nchr\t9\t19\tR2\nchr\t28\t35\tR3\n",
    "agg2.bed": "chr\t0\t4\tR1\t0\t+\nchr\t9\t19\tR2\t0\t+\nchr\t28\t35\tR3\t0\t+\nchr\t13\t22\tR4\t0\t-\n",
    "find_max_1.bed": "chr\t2\t5\nchr\t0\t10\nchr\t0\t20\nchr\t0\t15\n",
    "r0.bed": "chr\t13\t20\tR0\n",
    "yellow.bed": "chr\t2\t6\tR1\nchr\t28\t32\tR2\n",
    "to_new_main.chain": "chain 100 chr 36 + 0 36 chr 32 + 0 32 1\n23    4\t  0\n9\n",
    "to_new_transposon_and_gap.chain": "chain 100 chr 36 + 0 8 chr 19 + 0 10 1\n3\t0\t2\n5\n\nchain 100 chr 36 + 10 20 chr 19 - 0 10 2\n10\n",
}


def n(x, decimals=2):
    return "NA" if x is None else f"{x:.{decimals}f}"


def wig(values, decimals=1, kind="var"):
    """Signal text of bases by place; a header at each beginning."""
    out, before = [], None
    for p in sorted(values):
        if before is None or p != before + 1:
            out.append("variableStep chrom=chr span=1" if kind == "var" else f"fixedStep chrom=chr start={p + 1} step=1 span=1")
        out.append((f"{p + 1}\t" if kind == "var" else "") + n(values[p], decimals))
        before = p
    return out


def stats(every, values, decimals, names, fill=None, total=False):
    rows = [names]
    for a in range(0, 36, every):
        b = min(a + every, 36)
        v = sorted(x if x is not None else fill for x in values[a:b] if x is not None or fill is not None)
        k = len(v)
        cells = [v[0], v[-1], sum(v) / k, (v[(k - 1) // 2] + v[k // 2]) / 2] if k else [None] * 4
        rows.append("\t".join(map(str, ["chr", a, b, b - a, k])) + "".join("\t" + n(x, decimals) for x in cells + ([sum(v)] if total else [])))
    return rows


def sliding(fill=None, centre=False, skip=False):
    rows = []
    for i in range(33):
        v = [fill if x is None else x for x in MAIN[i : i + 4]]
        if not (skip and None in v):
            a, b = (i + 2, i + 3) if centre else (i, i + 4)
            rows.append(f"chr\t{a}\t{b}\t{','.join(map(n, v))}")
    return rows


def side_by_side(skip=False, consts=""):
    return [f"chr\t{p}\t{p + 1}\t{n(a)}\t{n(b)}{consts}" for p, (a, b) in enumerate(zip(MAIN, SECOND)) if not (skip and None in (a, b))]


REGIONS = [("R1", 0, 4, "+"), ("R2", 9, 19, "+"), ("R3", 28, 35, "+"), ("R4", 13, 22, "-")]


def cells(signal, at, left, right, strand):
    """Values from ``left`` before to ``right`` after an anchor, read along the strand."""
    span = range(at - left, at + right) if strand == "+" else range(at + left - 1, at - right - 1, -1)
    return [signal[p] if 0 <= p < 36 else None for p in span]


def matrix(keep):
    rows = []
    for name, s, e, strand in REGIONS:
        at = s if strand == "+" else e
        front = f"chr\t{at - 5}\t{at + 5}\t{name}\t0\t{strand}\t" if keep else ""
        rows.append(front + "\t".join(n(x, 1) for signal in (MAIN, SECOND) for x in cells(signal, at, 5, 5, strand)))
    return rows


def matrix_long(ends, side, tile):
    rows = []
    for k in range(2 * side // tile):
        position = k * tile - side
        for label, signal in (("Main", MAIN), ("Second", SECOND)):
            for name, s, e, strand in REGIONS:
                at = (e if ends else s) if strand == "+" else (s if ends else e)
                v = [x for x in cells(signal, at, side, side, strand)[k * tile : (k + 1) * tile] if x is not None]
                start = at - side + k * tile if strand == "+" else at + side - k * tile - 1
                rows.append(f"chr\t{start}\t{start + tile}\t{name}\t0\t{strand}\t{label}\t{position if position < 0 else position + tile}\t{n(sum(v) / len(v) if v else None, 1)}")
    return rows


def profile(values):
    return [f"{p}\t{x:.6f}" for p, x in zip((-3, -2, -1, 1, 2, 3), values)]


def at(places):
    return {p: MAIN[p] for p in places if MAIN[p] is not None}


# Texts that follow from no short rule.
TOP = ["chr\t2\t5\t.\t0\t+\t2\t5\t0\t1\t1,\t1,", "chr\t0\t10\t.\t0\t+\t0\t10\t0\t1\t1,\t3,", "chr\t0\t20\t.\t0\t+\t0\t20\t0\t1\t1,\t16,", "chr\t0\t15\t.\t0\t+\t0\t15\t0\t3\t1,1,1,\t3,10,11,"]
PEAKS = ["chr\t3\t4\t6.0\t1000\t+", "chr\t5\t6\t3.0\t1000\t-", "chr\t10\t11\t6.0\t1000\t+", "chr\t12\t13\t0.0\t1000\t-", "chr\t16\t17\t10.0\t1000\t+", "chr\t30\t31\t6.0\t1000\t+"]
FOUR, EIGHT = ("AAGTGCCGGGTTAACCTGGAAAA", "ACGTTGGGA"), ("ACLILGGLLLIIACGGMVVCCCA", "CGVIIVVVC")
UNLIFTED = ["chr\t7\tmulti_mapped_chr_9", "chr\t8\tdeleted_in_destination", "chr\t9\tdeleted_in_destination", "chr\t19\tmulti_mapped_chr_9"] + [f"chr\t{p}\tdeleted_in_destination" for p in (20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35)]
PAIRS = {("r0", "main"): (2, 3, 3, 10, 4, 4), ("r0", "second"): (2, 3, 3, 4, 4, 4)}


def two_and_two():
    yellow = {}
    for name, signal in (("main", MAIN), ("second", SECOND)):
        rows = [cells(signal, c, 3, 3, "+") for c in (4, 30)]
        yellow[name] = [sum(v) / len(v) for v in ([x for x in col if x is not None] for col in zip(*rows))]
    r0 = {name: cells(signal, 16, 3, 3, "+") for name, signal in (("main", MAIN), ("second", SECOND))}
    return [f"{bed}.bed\t{name}.wig\t{p}\t{v[name][i]:.6f}" for i, p in enumerate((-3, -2, -1, 1, 2, 3)) for bed, v in (("r0", r0), ("yellow", yellow)) for name in ("main", "second")]


HEAD = "#chrom\tstart\tend\tsize\tnum_data\tmin\tmax\tmean\tmedian"
CASES = {
    "agg 3:3 r0.bed,yellow.bed main.wig,second.wig out.txt": two_and_two,
    "agg 3:3 agg1.bed main.wig out.txt": lambda: profile((4.5, 5 / 3, 10 / 3, 14 / 3, 13 / 3, 19 / 3)),
    "agg -starts 3:3 agg1.bed main.wig out.txt": lambda: profile((3, 5, 3.5, 3, 4, 17 / 3)),
    "agg -ends 3:3 agg1.bed main.wig out.txt": lambda: profile((16 / 3, 13 / 3, 14 / 3, 3, 2.5, 2.5)),
    "chromgraph -every=5 main.wig out.txt": lambda: [f"chr\t{a + (min(a + 5, 36) - a) // 2}\t{n(sum(x for x in MAIN[a : a + 5] if x is not None) / max(1, sum(x is not None for x in MAIN[a : a + 5])))}" for a in range(0, 36, 5)],
    "dist main.wig out.txt": lambda: [f"{b}\t{MAIN.count(b)}" for b in range(11)],
    "extract bed agg1.bed main.wig out.txt": lambda: [f"chr\t{s}\t{e}\t{r}\t{e - s}\t{','.join(map(n, MAIN[s:e]))}" for r, s, e, _ in REGIONS[:3]],
    "fill 0 main.wig out.wig -decimals=1": lambda: wig({p: x or 0 for p, x in enumerate(MAIN)}),
    "find more 4 main.wig out.txt": lambda: [f"chr\t{a}\t{b}" for a, b in ((2, 5), (7, 12), (16, 17), (30, 32))],
    "find local-extrema main.wig out.txt -decimals=1": lambda: PEAKS,
    "find local-extrema main.wig out.txt -maxima -min-sep=10 -decimals=1": lambda: [PEAKS[0], PEAKS[4], PEAKS[5]],
    "find maxima find_max_1.bed main.wig out.txt": lambda: TOP,
    "find maxima find_max_1.bed main.wig out.txt -ave": lambda: TOP,
    "lift main.wig to_new_transposon_and_gap.chain out.wig -decimals=1": lambda: wig({**{p: MAIN[p] for p in range(3)}, **{p + 2: MAIN[p] for p in range(3, 7)}, **{28 - p: MAIN[p] for p in range(10, 19)}}),
    "lift main.wig to_new_transposon_and_gap.chain lifted.wig -unlifted=out.txt": lambda: UNLIFTED,
    "lift main.wig to_new_main.chain out.wig -decimals=1": lambda: wig({p if p < 23 else p - 4: x for p, x in enumerate(MAIN) if x is not None}),
    "matrix 5:5 agg2.bed main.wig,second.wig out.txt -starts -decimals=1": lambda: matrix(False),
    "matrix 5:5 agg2.bed main.wig,second.wig out.txt -starts -keep-bed -decimals=1": lambda: matrix(True),
    "matrix 5:5 agg2.bed main.wig,second.wig out.txt -ends -keep-bed -long-form=Main,Second -decimals=1": lambda: matrix_long(True, 5, 1),
    "matrix 4:4 agg2.bed main.wig,second.wig out.txt -starts -keep-bed -tiled-averages=2 -long-form=Main,Second -decimals=1": lambda: matrix_long(False, 4, 2),
    "paste main.wig second.wig -o=out.txt": side_by_side,
    "paste -skip-NA main.wig second.wig -o=out.txt": lambda: side_by_side(True),
    "paste -skip-NA -consts=3.4,-2.3 main.wig second.wig -o=out.txt": lambda: side_by_side(True, "\t3.40\t-2.30"),
    "remove mask agg1.bed -decimals=0 -wigtype=bg main.wig out.wig": lambda: [f"chr\t{p}\t{p + 1}\t{x}" for p, x in at(p for p in range(36) if not any(s <= p < e for _, s, e, _ in REGIONS[:3])).items()],
    "remove less 3 -decimals=1 -wigtype=fix main.wig out.wig": lambda: wig({p: x for p, x in enumerate(MAIN) if x is not None and x >= 3}, kind="fix"),
    "sax 4 main.wig out.txt -bed4": lambda: ["# alphabet size = 4"] + [f"chr\t{p}\t{p + 1}\t{c}" for start, word in zip((0, 27), FOUR) for p, c in enumerate(word, start)],
    "sax 4 main.wig out.txt": lambda: ["# alphabet size = 4", ">chr:0-23", FOUR[0], ">chr:27-36", FOUR[1]],
    "sax 8 main.wig out.txt": lambda: ["# alphabet size = 8", ">chr:0-23", EIGHT[0], ">chr:27-36", EIGHT[1]],
    "shift 3 main.wig out.wig -decimals=1": lambda: wig({p + 3: x for p, x in enumerate(MAIN) if x is not None and p + 3 < 36}),
    "shift -2 main.wig out.wig -decimals=1": lambda: wig({p - 2: x for p, x in enumerate(MAIN) if x is not None and p >= 2}),
    "summary 10 main.wig out.txt -header -fill=0 -with-sum": lambda: stats(10, MAIN, 2, HEAD + "\tsum", 0, True),
    "summary 3 main.wig out.txt -header -decimals=1": lambda: stats(3, MAIN, 1, HEAD),
    "window 4 main.wig -o=out.txt": sliding,
    "window 4 main.wig -o=out.txt -center": lambda: sliding(centre=True),
    "window 4 main.wig -o=out.txt -center -fill=0": lambda: sliding(0, True),
    "window 4 main.wig -o=out.txt -center -skip-NA": lambda: sliding(centre=True, skip=True),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("golden")
    for name, values in (("main", MAIN), ("second", SECOND)):
        (d / f"{name}.wig").write_text("\n".join(wig({p: x for p, x in enumerate(values) if x is not None})) + "\n")
    for name, said in FILES.items():
        (d / name).write_text(said)
    return d


def run(spark, folder, monkeypatch, line):
    monkeypatch.chdir(folder)
    cli.main(line.split(), spark=spark)
    return (folder / ("out.wig" if "out.wig" in line else "out.txt")).read_text().splitlines()


@pytest.mark.parametrize("line", CASES)
def test_text(spark, folder, monkeypatch, line):
    assert run(spark, folder, monkeypatch, line) == CASES[line]()


# Beyond the known texts: options and layouts.
MORE = {
    "paste -wigtype=var -header main.wig second.wig -skip-NA -o=out.txt": lambda: [x for p, (a, b) in enumerate(zip(MAIN, SECOND)) if a is not None for x in ([] if p not in (0, 27) else ["variableStep chrom=chr span=1"]) + [f"{p + 1}\t{n(a)}\t{n(b)}"]],
    "paste -wigtype=fix main.wig -skip-NA -o=out.txt": lambda: wig({p: x for p, x in enumerate(MAIN) if x is not None}, 2, "fix"),
    "paste -fill=9 main.wig second.wig -regions r0.bed -o=out.txt": lambda: [f"chr\t{p}\t{p + 1}\t{n(MAIN[p])}\t{n(SECOND[p])}" for p in range(13, 20)],
    "find more 4 main.wig out.txt -regions yellow.bed": lambda: ["chr\t2\t5", "chr\t30\t32"],
    "dist main.wig out.txt -regions yellow.bed": lambda: ["3\t2", "4\t1", "5\t2", "6\t3"],
    "extract bed agg2.bed main.wig out.txt -tabs -decimals=0": lambda: ["\t".join(["chr", str(s), str(e), r, "0", d, str(e - s), *(n(x, 0) for x in (MAIN[s:e] if d == "+" else MAIN[s:e][::-1]))]) for r, s, e, d in REGIONS],
    "extract jsp r0.bed main.wig out.txt -decimals=0": lambda: ["# R0"] + [n(x, 0) for x in MAIN[13:20]],
    "sax 4 main.wig out.txt -add-wig-out": lambda: ["# alphabet size = 4"] + [f"chr\t{p}\t{p + 1}\t{c}\t{MAIN[p]:.4f}" for start, word in zip((0, 27), FOUR) for p, c in enumerate(word, start)],
    "roll total 3 main.wig out.txt -max-NA=0 -regions r0.bed": lambda: ["fixedStep chrom=chr start=15 step=1 span=1"] + [n(sum(MAIN[p : p + 3])) for p in range(13, 18)],
    "find local-extrema main.wig out.txt -maxima -against=second.wig,1": lambda: [f"chr\t{p}\t{p + 1}\t{v}\t1000\t+" for p, v in ((3, 6), (16, 10), (30, 6))],
    "agg -long-form=a,b -header 3:3 agg1.bed main.wig out.txt -starts": lambda: ["Region\tSignal\tPosition\tMean"] + [f"a\tb\t{x}" for x in profile((3, 5, 3.5, 3, 4, 17 / 3))],
    "summary agg1.bed main.wig out.txt -zero-remove -skip-median -decimals=0": lambda: ["chr\t0\t4\t4\t4\t1\t6\t4", "chr\t9\t19\t10\t9\t2\t10\t5", "chr\t28\t35\t7\t7\t3\t6\t4"],
}


@pytest.mark.parametrize("line", MORE)
def test_options(spark, folder, monkeypatch, line):
    assert run(spark, folder, monkeypatch, line) == MORE[line]()


def test_meta_and_clusters(spark, folder, monkeypatch):
    rows = run(spark, folder, monkeypatch, "agg 2:4:2 agg1.bed main.wig out.txt")
    assert [r.split("\t")[0] for r in rows] == ["-2", "-1", "1", "2", "3", "4", "# meta part ends here", "5", "6"]
    assert len(run(spark, folder, monkeypatch, "matrix 2:4:2 agg2.bed main.wig,second.wig out.txt")[0].split("\t")) == 16
    rows = run(spark, folder, monkeypatch, "agg 2:2 agg2.bed second.wig out.txt -cluster=2 -fill=0 -cluster-sets=sets.txt")
    assert [r.split("\t")[0] for r in rows] == ["-2", "-1", "1", "2"] and {len(r.split("\t")) for r in rows} == {3}
    assert sorted(len(r.split("\t")) for r in (folder / "sets.txt").read_text().splitlines()) == [13] * 4
    rows = run(spark, folder, monkeypatch, "matrix 2:2 agg2.bed second.wig out.txt -cluster=2 -fill=0 -cluster-centroids=centres.txt")
    assert len(rows) == 4 and {len(r.split("\t")) for r in rows} == {6}
    assert (folder / "centres.txt").read_text().startswith("# num NA = 0, num total = 4\ncluster 0\tsize = ")
    rows = run(spark, folder, monkeypatch, "matrix 2:2 agg2.bed second.wig out.txt -cluster=2 -fill=0 -long-form=S")
    assert len(rows) == 16 and rows[0].split("\t")[1].startswith("Cluster_") and rows[0].split("\t")[4] == "S_1"


@pytest.mark.parametrize("line", ["summary 3 a.wig out -fill=0 -total", "agg 3:3 r.bed a.wig out -starts -ends", "window 3 a.wig -skip-NA -fill=1", "dist a.wig out -cluster=2", "matrix 2:2:2 r.bed a.wig out -long-form", "find local-extrema a.wig out -against=b.wig,2"])
def test_contradictions_are_refused(line, capsys):
    with pytest.raises(SystemExit):
        cli.main(line.split(), spark=object())
    assert "error:" in capsys.readouterr().err
