"""Command line: one subcommand for each operator.  Signals are bigWig or signal text; output goes to a file or stdout."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import filters, profiles, shapes, summaries, windows
from .operators.lift import lift
from .plans.intervals import clip, condense, sections_of
from .sources import bigwig, sinks, text

ALIASES = {"dist": "distribution", "agg": "aggregate", "cg": "chromgraph", "win": "window", "ex": "extract"}
ARGUMENTS = {
    "remove": "op what signal out", "fill": "value signal out", "shift": "n signal out", "find": "op rest*", "distribution": "signal out", "chromgraph": "signal out", "aggregate": "window regions signals out",
    "summary": "loci signal out", "split": "size signal out", "matrix": "window regions signals out", "sax": "alphabet signal out", "lift": "signal chain out", "paste": "signals+", "window": "size signal", "extract": "style regions signal out", "roll": "fn size signal out", "random": "n size signal out", "autocorr": "lags signal out",
}
FLAGS = "inverse condense wig-only keep-bed header total starts ends firstbase expanded skip-NA center maxima minima median-base with-max with-quantiles with-sum with-sum-of-squares skip-median locus-name tabs bed4 add-wig-out zero-remove consts-means consts-totals consts-covs long-form-header strict zoom"
NUMBERS: dict[str, tuple[Callable, object]] = {
    "decimals": (int, 2), "fill": (float, None), "step": (int, 1), "min-sep": (int, 0), "max-NA": (int, None), "min-mean": (float, None), "every": (int, 10_000), "mult": (float, 1.0), "cluster": (int, None), "tiled-averages": (int, 1), "skip-min": (float, None), "mean": (float, None), "std": (float, None),
    "min-gap": (int, 1), "seed": (int, 1), "NA-perc": (float, 0.4), "sax-window": (int, 0), "bed-ix": (int, None), "bw-ix": (int, None),
}
WORDS = "blacklist regions wigtype unlifted sizes o consts against binary-matrix cluster-sets cluster-centroids long-form"
#: What makes no use of -regions: they read whole signals around regions of their own.
UNRESTRICTED = {"aggregate", "matrix", "extract"}


_loaded: list[DataFrame] = []


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Signal and sizes; ``file:chrom:start-end`` restricts to a part."""
    place = None
    if path.count(":") >= 2 and "-" in path.rsplit(":", 1)[1]:
        path, chrom, span = path.rsplit(":", 2)
        place = chrom, *map(int, span.split("-"))
    if path.endswith((".bw", ".bigWig", ".bigwig")):
        signal, sizes = bigwig.read_bigwig(spark, path), bigwig.bigwig_sizes(spark, path)
    else:
        signal = text.read_wig(spark, path).persist()  # parsed once; dropped when the command ends
        _loaded.append(signal)
        sizes = signal.groupBy("chrom").agg(F.max("end").alias("size"))
    if place:
        c, a, b = place
        signal = signal.where((F.col("chrom") == c) & (F.col("start") < b) & (F.col("end") > a)).select("chrom", F.greatest("start", F.lit(a)).alias("start"), F.least("end", F.lit(b)).alias("end"), "value")
        sizes = sizes.where(F.col("chrom") == c)
    return signal, sizes


def restricted(spark: SparkSession, o, signal: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signal and the sections to work on: whole chromosomes, or the regions asked for and what lies in them."""
    if not o.regions or o.command in UNRESTRICTED:
        return signal, sections_of(sizes)
    sections = text.read_bed(spark, o.regions).select(F.col("row_id").alias("section_id"), "chrom", "start", "end")
    return clip(signal, sections).select("chrom", "start", "end", "value"), sections


def store(signal: DataFrame, sizes: DataFrame, path: str, o) -> None:
    signal = condense(signal) if o.condense else signal
    if path.endswith((".bw", ".bigWig", ".bigwig")) and not o.wig_only:
        bigwig.write_bigwig(signal, sizes, path)
    else:
        with _out(path) as f:
            sinks.write_wig(signal, f, o.wigtype or "var", o.decimals)


def _out(path: str | None):
    return open(path, "w", encoding="utf-8") if path and path not in ("-", "stdout", "/dev/stdout") else open(sys.stdout.fileno(), "w", closefd=False, encoding="utf-8")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparsetrack", allow_abbrev=False)
    p.add_argument("--version", "-V", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, positional in ARGUMENTS.items():
        s = sub.add_parser(name, aliases=[a for a, n in ALIASES.items() if n == name], allow_abbrev=False)
        for x in positional.split():
            s.add_argument(x.rstrip("*+"), nargs=x[-1] if x[-1] in "*+" else None)
        for flag in FLAGS.split():
            s.add_argument(f"-{flag}", f"--{flag}", action="store_true")
        for flag, (kind, default) in NUMBERS.items():
            s.add_argument(f"-{flag}", f"--{flag}", type=kind, default=default)
        for flag in WORDS.split():
            s.add_argument(f"-{flag}", f"--{flag}")
    return p


def parsed(argv: list[str]):
    """Options of a command line; those it doesn't know are named on stderr and passed over, or, with -strict, refused."""
    p = parser()
    # an option whose value may be left out
    o, unknown = p.parse_known_args([f"{a}=on" if a.lstrip("-") == "long-form" and a[0] == "-" else a for a in argv])
    o.command = ALIASES.get(o.command, o.command)
    if strange := [a for a in unknown if not a.startswith("-")]:
        p.error(f"unrecognized arguments: {' '.join(strange)}")
    if unknown and o.strict:
        p.error(f"unknown options: {' '.join(unknown)}")
    if unknown:
        print(f"sparsetrack: ignored: {' '.join(unknown)}", file=sys.stderr)
    if wrong := conflict(o):
        p.error(wrong)
    return o


def conflict(o) -> str | None:
    """Options that contradict each other or the command."""
    c = o.command
    meta = c in ("aggregate", "matrix") and o.window.count(":") == 2
    if c == "summary" and o.total and o.fill is not None:
        return "-fill and -total can't be used together"
    if o.starts and o.ends:
        return "-starts and -ends can't be used together"
    if meta and (o.starts or o.ends or o.firstbase) and c == "aggregate":
        return "-starts, -ends and -firstbase can't be used with a meta part"
    if meta and c == "matrix" and (o.long_form or o.tiled_averages > 1):
        return "a meta part has neither a long form nor tiles"
    if o.cluster is not None and (c not in ("aggregate", "matrix") or not 2 <= o.cluster <= 10 or (meta and c == "aggregate")):
        return "-cluster is for aggregate (without a meta part) and matrix, with 2 to 10 clusters"
    if (o.cluster_sets and c != "aggregate") or (o.cluster_centroids and c != "matrix") or ((o.cluster_sets or o.cluster_centroids) and o.cluster is None):
        return "-cluster-sets (aggregate) and -cluster-centroids (matrix) go with -cluster"
    if c == "window" and o.skip_NA and o.fill is not None:
        return "-skip-NA and -fill can't be used together"
    if o.sax_window < 0 or (o.sax_window > 1 and (c != "sax" or o.bed4 or o.add_wig_out)):
        return "-sax-window is for sax, and its words only"
    if o.against and not (o.maxima or o.minima):
        return "-against goes with -maxima or -minima"
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parsed(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("sparsetrack").getOrCreate()
    try:
        COMMANDS[o.command](spark, o)
    finally:
        while _loaded:
            _loaded.pop().unpersist()


def _one(spark: SparkSession, o) -> tuple[DataFrame, DataFrame, DataFrame]:
    signal, sizes = load(spark, o.signal)
    return *restricted(spark, o, signal, sizes), sizes


def _remove(spark, o) -> None:
    signal, _, sizes = _one(spark, o)
    store(filters.remove_mask(signal, text.read_bed(spark, o.what), o.inverse) if o.op == "mask" else filters.remove_threshold(signal, o.op, float(o.what), o.inverse), sizes, o.out, o)


def _fill(spark, o) -> None:
    signal, sections, sizes = _one(spark, o)
    store(filters.fill(signal, sections, float(o.value)), sizes, o.out, o)


def _shift(spark, o) -> None:
    signal, sections, sizes = _one(spark, o)
    store(filters.shift(signal, sections, int(o.n)), sizes, o.out, o)


# What is said of a base that isn't lifted.
REASONS = {"deleted": "deleted_in_destination", "duplicated": "duplicated_in_destination", "problem": "problem_lifting", "off_end": "off_end"}


def _lift(spark, o) -> None:
    signal, _, _ = _one(spark, o)
    blocks = text.read_chain(spark, o.chain)
    target = text.read_sizes(spark, o.sizes) if o.sizes else text.chain_sizes(blocks)
    lifted, rest = lift(signal, blocks, target)
    store(lifted, target, o.out, o)
    if o.unlifted:
        plain = F.element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), F.col("reason"))
        said = F.when(F.col("reason") == "multi_mapped", F.concat_ws("_", "reason", "q_name", F.col("q_pos").cast("string"))).otherwise(plain)
        with _out(o.unlifted) as f:
            sinks.write_table(rest.select("chrom", "pos", said.alias("said")), f, ["chrom", "pos", "said"], order=["chrom", "pos"])


def _find(spark, o) -> None:
    *args, out = o.rest
    path = args[-1]
    signal, sizes = load(spark, path)
    if o.op == "maxima":  # looks at its own regions
        found = profiles.maxima(signal, text.read_bed(spark, args[0]), o.median_base).withColumn("blocks", F.size("offsets")).withColumn("ones", F.transform("offsets", lambda x: F.lit(1)))
        columns, order = ["chrom", "start", "end", "name", "score", "strand", "start", "end", "rgb", "blocks", "ones", "offsets"], ["row_id"]
        listed = lambda c: F.concat(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(","))
        found = found.withColumn("score", F.col("score").cast("long")).withColumn("rgb", F.lit(0)).withColumn("ones", listed("ones")).withColumn("offsets", listed("offsets"))
        if o.with_max:
            found, columns = found.withColumn("maximum", F.col("maximum")), [*columns, "maximum"]
        with _out(out) as f:
            sinks.write_table(found, f, columns, 6, order)
        return
    signal, sections = restricted(spark, o, signal, sizes)
    if o.op == "local-extrema":
        against, _, reach = (o.against or "").partition(",")
        other = load(spark, against)[0] if against else None
        found = shapes.local_extrema(signal, o.min_sep, "maxima" if o.maxima else "minima" if o.minima else None, other, int(reach or 0))
        found = found.withColumn("end", F.col("pos") + 1).withColumn("score", F.lit(1000))
        if against:
            found = found.withColumn("value", F.col("value").cast("long"))
        columns, order = ["chrom", "pos", "end", "value", "score", "strand"], ["chrom", "pos"]
    else:
        found, columns, order = filters.find_threshold(signal, o.op, float(args[0]), o.inverse, sections), ["chrom", "start", "end"], ["chrom", "start"]
    with _out(out) as f:
        sinks.write_table(found, f, columns, o.decimals, order)


def _distribution(spark, o) -> None:
    with _out(o.out) as f:
        sinks.write_table(summaries.distribution(_one(spark, o)[0], o.mult), f, ["bin", "count"], order=["bin"])


def _chromgraph(spark, o) -> None:
    zoomed = bigwig.zoomed_graph(spark, o.signal, o.every) if o.zoom and not o.regions and o.fill is None and o.signal.endswith((".bw", ".bigWig", ".bigwig")) else None
    if zoomed is not None:
        with _out(o.out) as f:
            sinks.write_table(zoomed, f, ["chrom", "middle", "mean"], o.decimals, ["chrom", "middle"])
        return
    signal, sections, _ = _one(spark, o)
    if o.fill is not None:
        signal = filters.fill(signal, sections, o.fill)
    with _out(o.out) as f:
        sinks.write_table(summaries.chromgraph(signal, sections, o.every), f, ["chrom", "middle", "mean"], o.decimals, ["chrom", "middle"])


def _summary(spark, o) -> None:
    signal, sections, _ = _one(spark, o)
    bed = None if o.loci.isdigit() else text.read_bed(spark, o.loci)
    loci = int(o.loci) if bed is None else bed.select("row_id", "chrom", "start", "end", "name", "score", "strand")
    near_zero = 10.0 ** -(o.decimals + 1) if o.zero_remove else None
    df = summaries.summary(signal, loci, sections, o.with_quantiles, o.with_sum, o.with_sum_of_squares, not o.skip_median, o.fill, near_zero, o.total)
    names = {"q10": "first_10%", "q25": "1st_quart", "q75": "3rd_quart", "q90": "last_10%", "sum_squares": "sum_of_squares"}
    middle = ["q10", "q25", "median", "q75", "q90"] if o.with_quantiles else [] if o.skip_median else ["median"]
    stats = ["size", "num_data", "min", "max", "mean", *middle, *(["sum_squares"] if o.with_sum_of_squares else []), *(["sum"] if o.with_sum else [])]
    if bed is not None and not o.total:
        df = df.withColumn("score", F.col("score").cast("long"))
    columns = stats if o.total else ["chrom", "start", "end", *(["name", "score", "strand"] if o.keep_bed and bed is not None else []), *stats]
    with _out(o.out) as f:
        sinks.write_table(df, f, columns, o.decimals, None if o.total else ["chrom", "start"] if bed is None else ["row_id"], o.header, labels=[names.get(c, c) for c in columns])


def _inputs(spark, o) -> tuple[list[tuple[str, DataFrame]], list[tuple[str, DataFrame]], list[int], str]:
    beds = [(n, text.read_bed(spark, p)) for n, p in text.labelled_files(o.regions, o.bed_ix)]
    signals = [(n, load(spark, p)[0]) for n, p in text.labelled_files(o.signals, o.bw_ix)]
    return beds, signals, [int(x) for x in o.window.split(":")], "starts" if o.starts else "ends" if o.ends else "centre"


def _labels(o, many: int, own: list[str]) -> list[str]:
    given = None if o.long_form in (None, "on") else o.long_form.split(",")
    if given is not None and len(given) != many:
        raise SystemExit(f"sparsetrack: {len(given)} labels for {many} inputs")
    return given or own


EXPANDED = {"mean": "Mean", "median": "Median", "sd": "Std_Dev", "n": "Num_Data", "sum_squares": "Sum_Squares", "se": "Std_Err_Mean", "low": "Y_Low", "high": "Y_High"}


def _aggregate(spark, o) -> None:
    beds, signals, parts, anchor = _inputs(spark, o)
    if o.cluster is not None:
        return _aggregate_clusters(spark, o, beds[0][1], signals[0], parts, anchor)
    sets, tracks = {f"r{i}": r for i, (_, r) in enumerate(beds)}, {f"s{i}": s for i, (_, s) in enumerate(signals)}
    labels = _labels(o, len(beds) + len(signals), [n for n, _ in beds] + [n for n, _ in signals])
    label = dict(zip([*sets, *tracks], labels, strict=True))
    stats = list(EXPANDED) if o.expanded else ["mean"]
    body = None
    if len(parts) == 3:
        left, meta, right = parts
        width = meta if meta > 0 else max(1, round(sum(profiles.mean_length(r) for r in sets.values()) / len(sets)))
        df = profiles.aggregate_meta(sets, tracks, left, width, right, o.expanded, o.fill)
        body = left + width
    else:
        left, right = parts
        df = profiles.aggregate(sets, tracks, left, right, anchor, o.firstbase, o.expanded, o.fill)
    cells: dict[int, dict[tuple[str, str], list]] = {}
    for r in df.select("position", "region_set", "signal", *stats).collect():  # a row for each position, set and signal
        cells.setdefault(r["position"], {})[(r["region_set"], r["signal"])] = [r[c] for c in stats]
    said = lambda row: "\t".join(str(x) if c == "n" else sinks.number(x, 6) for c, x in zip(stats, row, strict=True))
    pairs = list(product(sets, tracks))
    long = o.long_form is not None or (len(beds) > 1 and len(signals) > 1)
    with _out(o.out) as f:
        if o.header:
            names = [EXPANDED[c] for c in stats]
            f.write("\t".join(["Region", "Signal", "Position", *names] if long else ["Position", *(f"{n}_{k + 1}" for k in range(len(pairs)) for n in names)]) + "\n")
        for i, position in enumerate(sorted(cells)):
            if i == body:
                f.write("# meta part ends here\n")
            row = [said(cells[position][p]) for p in pairs]
            f.writelines(f"{label[a]}\t{label[b]}\t{position}\t{x}\n" for (a, b), x in zip(pairs, row, strict=True)) if long else f.write("\t".join([str(position), *row]) + "\n")


def _aggregate_clusters(spark, o, bed: DataFrame, signal: tuple[str, DataFrame], parts: list[int], anchor: str) -> None:
    """Centroids as columns; with -cluster-sets the regions, their clusters and windows."""
    m = profiles.matrix(bed, {"s": signal[1]}, *parts, anchor, fill=o.fill)
    labelled, centres = profiles.cluster(m, o.cluster)
    with _out(o.out) as f:
        for i in range(sum(parts)):
            p = i - parts[0]
            f.write("\t".join([str(p + 1 if p >= 0 else p), *(sinks.number(c[i], 6) for c in centres)]) + "\n")
    if o.cluster_sets:
        whole = bed.select("row_id", "chrom", F.col("start").alias("o_start"), F.col("end").alias("o_end"), "name", F.col("score").cast("long").alias("score"), F.col("strand").alias("o_strand"))
        df = labelled.drop("chrom").join(whole, "row_id").withColumn("label", F.coalesce("label", F.lit(-1)))
        with _out(o.cluster_sets) as f:
            sinks.write_table(df, f, ["chrom", "o_start", "o_end", "name", "score", "o_strand", "label", "chrom", "start", "end", "name", "score", "strand"], order=["label", "distance", "row_id"])


def _matrix(spark, o) -> None:
    beds, signals, parts, anchor = _inputs(spark, o)
    bed, tracks = beds[0][1], {f"s{i}": s for i, (_, s) in enumerate(signals)}
    names = _labels(o, len(signals), [n for n, _ in signals])
    six = ["chrom", "start", "end", "name", "score", "strand"]
    about = bed.select("row_id", "name", F.col("score").cast("long").alias("score"))
    if len(parts) == 3:
        left, meta, right = parts
        width = meta if meta > 0 else max(1, profiles.mean_length(bed))
        df = profiles.matrix_meta(bed, tracks, left, width, right)
        columns = left + width + right
    else:
        left, right = parts
        if o.long_form is not None and o.cluster is None:
            return _matrix_long(o, bed, about, dict(zip(tracks, names, strict=True)), tracks, left, right, anchor)
        df, columns = profiles.matrix(bed, tracks, left, right, anchor, o.tiled_averages, o.fill), (left + right) // o.tiled_averages
    df = df.join(about, "row_id")
    order, front = ["row_id"], six if o.keep_bed else []
    if o.cluster is not None:
        df, centres = profiles.cluster(df, o.cluster)
        if o.cluster_centroids:
            _write_centres(df, centres, o.cluster_centroids)
        if o.long_form is not None:
            return _clusters_long(o, df, names, columns)
        df = df.withColumn("label", F.coalesce("label", F.lit(-1)))
        order, front = ["label", "distance", "row_id"], [*front, "label", "distance"]
        df = df.withColumn("distance", F.format_string("%.6f", F.coalesce("distance", F.lit(0.0))))
    if o.binary_matrix:
        sinks.write_matrix(df, o.out, o.keep_bed)
        return
    with _out(o.out) as f:
        sinks.write_table(df, f, [*front, "values"], o.decimals, order, between="\t")


def _matrix_long(o, bed, about, label, tracks, left, right, anchor) -> None:
    tile = o.tiled_averages
    df = profiles.matrix_long(bed, tracks, left, right, anchor, tile, o.fill).join(about, "row_id")
    k = F.when(F.col("position") > 0, F.col("position") - tile + left).otherwise(F.col("position") + left)
    at = F.when(F.col("strand") == "-", F.col("end") - k - 1).otherwise(F.col("start") + k)
    df = df.withColumn("at", at).withColumn("to", F.col("at") + tile).withColumn("nth", F.col("signal").substr(2, 9).cast("int"))
    df = df.withColumn("signal", F.element_at(F.create_map(*(F.lit(x) for kv in label.items() for x in kv)), F.col("signal")))
    columns = ["chrom", "at", "to", "name", "score", "strand", "signal", "position", "value"] if o.keep_bed else ["signal", "name", "position", "value"]
    said = ["chrom", "chromStart", "chromEnd", "name", "score", "strand", "Signal", "Position", "Value"] if o.keep_bed else ["Signal", "Region", "Position", "Value"]
    with _out(o.out) as f:
        if o.long_form_header or o.header:
            f.write("\t".join(said) + "\n")
        sinks.write_table(df, f, columns, o.decimals, ["position", "nth", "row_id"])


def _clusters_long(o, df: DataFrame, names: list[str], columns: int) -> None:
    """A row for each value of the clustered regions, cluster by cluster, the nearest to its centre first."""
    from pyspark.sql import Window

    sub = columns
    w = Window.partitionBy("label").orderBy("distance", "row_id")
    sizes = df.where("label is not null").groupBy("label").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each cluster
    rows = df.where("label is not null").withColumn("nth", F.row_number().over(w)).join(F.broadcast(sizes.select("label", "before")), "label")
    each = rows.select("*", F.posexplode("values").alias("i", "value")).withColumn("row", F.col("before") + F.col("nth")).withColumn("cluster", F.concat(F.lit("Cluster_"), F.col("label") + 1))
    each = each.withColumn("of", F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("i") / sub) + 1).cast("int"))).withColumn("sub", F.col("i") % sub + 1).withColumn("column", F.col("i") + 1)
    each = each.withColumn("of_sub", F.concat_ws("_", "of", F.col("sub").cast("string")))
    front = ["chrom", "start", "end", "name", "score", "strand"] if o.keep_bed else []
    with _out(o.out) as f:
        if o.long_form_header or o.header:
            f.write("\t".join([*(["chrom", "chromStart", "chromEnd", "name", "score", "strand"] if front else []), "Row", "Cluster_Name", "Cluster_Row", "Centroid_Distance", "Label_Subpos", "Label", "Subpos", "Column", "Data"]) + "\n")
        sinks.write_table(each, f, [*front, "row", "cluster", "nth", "distance", "of_sub", "of", "sub", "column", "value"], 6, ["row", "i"])


def _write_centres(df: DataFrame, centres: list[list[float]], path: str) -> None:
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}  # at most eleven rows
    gaps = counts.pop(None, 0)
    total = sum(counts.values())
    with _out(path) as f:
        f.write(f"# num NA = {gaps}, num total = {total}\n")
        for i, c in enumerate(centres):
            f.write(f"cluster {i}\tsize = {counts.get(i, 0)} ({counts.get(i, 0) / total:.2f})\tvalues = {','.join(f'{x:.6f}' for x in c)}\n")


def _split(spark, o) -> None:
    with _out(o.out) as f:
        sinks.write_table(shapes.split_chunks(_one(spark, o)[0], int(o.size), o.min_gap), f, ["chrom", "start", "end", "chunk"], order=["chunk", "chrom", "start"])


def _sax(spark, o) -> None:
    signal, sections, _ = _one(spark, o)
    k = int(o.alphabet)
    with _out(o.out) as f:
        f.write(f"# alphabet size = {k}\n")
        if not (o.bed4 or o.add_wig_out):
            sinks.write_words(shapes.sax_words(signal, sections, k, o.mean, o.std, max(1, o.sax_window)), f)
            return
        rows = shapes.sax(signal, k, o.mean, o.std)
        each = rows.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1))).withColumn("to", F.col("pos") + 1)
        sinks.write_table(each, f, ["chrom", "pos", "to", "letter", *(["value"] if o.add_wig_out else [])], 4, ["chrom", "pos"])


def _paste(spark, o) -> None:
    files = text.labelled_files(o.signals)
    loaded = [load(spark, p) for _, p in files]
    first, sections = restricted(spark, o, *loaded[0])
    tracks = {f"s{i}": s for i, s in enumerate([first, *(s for s, _ in loaded[1:])])}
    consts = [float(x) for x in o.consts.split(",")] if o.consts else []
    for s in tracks.values():
        if o.consts_means or o.consts_totals or o.consts_covs:
            r = summaries.whole(s).first()
            consts += [float(r[c]) for c, on in (("mean", o.consts_means), ("total", o.consts_totals), ("covered", o.consts_covs)) if on]
    df = windows.paste(tracks, sections, o.skip_NA, o.skip_min, {f"c{i}": x for i, x in enumerate(consts)}, fill=o.fill)
    columns = [*tracks, *(f"c{i}" for i in range(len(consts)))]
    if o.header:
        print("\t".join(["#chrom", "chromStart", "chromEnd", *(n for n, _ in files), *(f"Constant_{i + 1}" for i in range(len(consts)))]))
    with _out(o.o) as f:
        sinks.write_steps(df.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1), f, columns, o.wigtype or "bg", o.decimals, ["chrom", "pos"])


def _window(spark, o) -> None:
    signal, sections, _ = _one(spark, o)
    with _out(o.o) as f:
        sinks.write_table(windows.window(signal, sections, int(o.size), o.step, o.skip_NA, o.center, o.fill), f, ["chrom", "start", "end", "values"], o.decimals, ["chrom", "start"])


def _roll(spark, o) -> None:
    signal, sections, _ = _one(spark, o)
    df = windows.roll(signal, sections, o.fn, int(o.size), o.step, o.max_NA, o.min_mean, o.fill)
    with _out(o.out) as f:
        sinks.write_steps(df, f, ["value"], o.wigtype or "fix", o.decimals, ["chrom", "start"], o.step)


def _extract(spark, o) -> None:
    signal, _, _ = _one(spark, o)
    bed = text.read_bed(spark, o.regions)
    with _out(o.out) as f:
        if o.style == "jsp":
            sinks.write_listed(profiles.extract_lines(signal, bed, o.locus_name, o.fill), f, o.decimals)
            return
        n = bed.agg(F.max("n_fields")).first()[0] or 3
        df = profiles.extract(signal, bed, o.fill).withColumn("score", F.col("score").cast("long"))
        sinks.write_table(df, f, ["chrom", "start", "end", *["name", "score", "strand"][: max(0, min(6, n) - 3)], "length", "values"], o.decimals, ["row_id"], between="\t" if o.tabs else ",")


def _random(spark, o) -> None:
    signal, sections, _ = _one(spark, o)
    barred = text.read_bed(spark, o.blacklist).select("chrom", "start", "end") if o.blacklist else None
    with _out(o.out) as f:
        sinks.write_table(shapes.random_regions(signal, sections, int(o.n), int(o.size), o.NA_perc, barred, o.seed), f, ["chrom", "start", "end"], order=["chrom", "start"])


def _autocorr(spark, o) -> None:
    signal, sections, _ = _one(spark, o)
    with _out(o.out) as f:
        sinks.write_table(windows.autocorrelation(signal, sections, int(o.lags)), f, ["lag", "n", "covariance", "correlation"], 6, ["lag"], header=True)


COMMANDS = {name: globals()[f"_{name}"] for name in ARGUMENTS}


if __name__ == "__main__":
    main()
