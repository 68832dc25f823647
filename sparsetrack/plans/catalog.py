"""Registered queries on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, profiles, shapes, summaries, windows
from ..operators.lift import lift
from . import inputs
from .intervals import bases, condense, dense, merge, sections_of

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}

E = """
 ev AS (SELECT event_type AS chrom, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS BIGINT) AS pos,
   CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
 ch AS (SELECT DISTINCT chrom FROM ev),
 d AS (SELECT c.chrom, CAST(t.g AS BIGINT) AS pos, ev.v, ev.n FROM ch c CROSS JOIN range(0, 720) t(g) LEFT JOIN ev ON ev.chrom = c.chrom AND ev.pos = t.g),
 rg AS (SELECT chrom || ':' || n_nationkey AS row_id, chrom, CAST(n_nationkey * 30 AS BIGINT) AS s, CAST(n_nationkey * 30 + 10 + n_nationkey % 7 AS BIGINT) AS e, n_name AS name,
   CASE WHEN n_nationkey % 2 = 1 THEN '-' ELSE '+' END AS strand FROM nation CROSS JOIN ch),
 mk AS (SELECT chrom, CAST(r_regionkey * 140 AS BIGINT) AS s, CAST(r_regionkey * 140 + 37 AS BIGINT) AS e FROM region CROSS JOIN ch)"""


def query(sql: str | None):
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql and (f"WITH RECURSIVE {E.strip()}{sql}" if sql.startswith(",") else f"WITH {E.strip()} {sql}"))
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}


def _e(spark: SparkSession, sf_dir: str):
    e = inputs.events(spark, sf_dir)
    return e, sections_of(inputs.sizes(e, inputs.HOURS))


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


_STATS = "count(v) AS num_data, min(v) AS min, max(v) AS max, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median"


@query(f"SELECT chrom, pos // 24 * 24 AS start, pos // 24 * 24 + 24 AS \"end\", CAST(24 AS BIGINT) AS size, {_STATS} FROM d GROUP BY chrom, pos // 24")
def summary_tiles(spark, sf_dir):
    e, c = _e(spark, sf_dir)
    return _r(summaries.summary(e, 24, c), "mean", "median").drop("section_id")


_REGION = "FROM rg LEFT JOIN ev ON ev.chrom = rg.chrom AND ev.pos >= rg.s AND ev.pos < rg.e"


@query(f"SELECT rg.chrom, s AS start, e AS \"end\", name, e - s AS size, {_STATS} {_REGION} GROUP BY ALL")
def summary_bed(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return _r(summaries.summary(e, inputs.regions(spark, sf_dir, e).drop("row_id", "strand")), "mean", "median")


@query(
    "SELECT rg.chrom, s AS start, name, count(v) AS num_data, round(quantile_cont(v, 0.1), 9) AS q10, round(quantile_cont(v, 0.25), 9) AS q25, round(quantile_cont(v, 0.5), 9) AS median, "
    f"round(quantile_cont(v, 0.75), 9) AS q75, round(quantile_cont(v, 0.9), 9) AS q90 {_REGION} GROUP BY ALL"
)
def summary_quantiles(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    q = ("q10", "q25", "median", "q75", "q90")
    return _r(summaries.summary(e, inputs.regions(spark, sf_dir, e).drop("row_id", "strand"), quantiles=True), *q).select("chrom", "start", "name", "num_data", *q)


@query(
    f", j AS (SELECT rg.row_id, rg.chrom, s, v, avg(v) OVER (PARTITION BY rg.row_id) AS m {_REGION})"
    " SELECT chrom, s AS start, round(sum((v - m) * (v - m)), 6) AS sum_squares, round(sum(v), 4) AS sum FROM j GROUP BY row_id, chrom, s"
)
def summary_sos(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    out = summaries.summary(e, inputs.regions(spark, sf_dir, e).drop("row_id", "strand"), squares=True, with_sum=True)
    return out.select("chrom", "start", F.round("sum_squares", 6).alias("sum_squares"), F.round("sum", 4).alias("sum"))


@query(f"SELECT CAST((SELECT sum(e - s) FROM rg) AS BIGINT) AS size, {_STATS} FROM rg JOIN ev ON ev.chrom = rg.chrom AND ev.pos >= rg.s AND ev.pos < rg.e")
def summary_total(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return _r(summaries.summary(e, inputs.regions(spark, sf_dir, e).drop("row_id", "strand"), total=True), "mean", "median")


@query("SELECT chrom, pos // 24 * 24 AS start, count(*) AS num_data, round(avg(coalesce(v, 0)), 9) AS mean, round(sum(coalesce(v, 0)), 4) AS sum FROM d GROUP BY chrom, pos // 24")
def summary_filled(spark, sf_dir):
    e, c = _e(spark, sf_dir)
    out = summaries.summary(e, 24, c, with_sum=True, median=False, fill=0.0)
    return out.select("chrom", "start", "num_data", F.round("mean", 9).alias("mean"), F.round("sum", 4).alias("sum"))


def _islands(where: str) -> str:
    return f", k AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM ev WHERE {where}) SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\" FROM k GROUP BY chrom, g"


@query(_islands("v > 100"))
def find_more(spark, sf_dir):
    return filters.find_threshold(_e(spark, sf_dir)[0], "more", 100)


@query(_islands("v <= 150"))
def find_less_equal(spark, sf_dir):
    e, c = _e(spark, sf_dir)
    return filters.find_threshold(e, "less-equal", 150, sections=c)


@query(_islands("NOT (v < 80)"))
def find_inverse(spark, sf_dir):
    return filters.find_threshold(_e(spark, sf_dir)[0], "less", 80, inverse=True)


_TOP = ", j AS (SELECT rg.row_id, rg.chrom, rg.s, rg.name, v, pos - s AS o, max(v) OVER (PARTITION BY rg.row_id) AS m FROM rg JOIN ev ON ev.chrom = rg.chrom AND ev.pos >= rg.s AND ev.pos < rg.e) "


@query(_TOP + "SELECT chrom, s AS start, name, m AS maximum, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS offsets FROM j WHERE v = m GROUP BY ALL")
def find_maxima(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    out = profiles.maxima(e, inputs.regions(spark, sf_dir, e))
    return out.select("chrom", "start", "name", "maximum", F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


@query(_TOP.replace("v, pos", "n AS v, pos").replace("max(v)", "max(n)") + "SELECT chrom, s AS start, CAST(floor(quantile_cont(o, 0.5)) AS BIGINT) AS at FROM j WHERE v = m GROUP BY ALL")
def find_maxima_median(spark, sf_dir):
    e = inputs.events(spark, sf_dir, what="count")
    return profiles.maxima(e, inputs.regions(spark, sf_dir, e), median_base=True).select("chrom", "start", F.col("offsets")[0].cast("long").alias("at"))


@query(
    ", r AS (SELECT chrom, pos, n, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(n) OVER w = n THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)),"
    " g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS i FROM r), f AS (SELECT chrom, min(pos) AS s, max(pos) + 1 AS e, any_value(n) AS n FROM g GROUP BY chrom, i),"
    " x AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN lag(n) OVER w END AS b, CASE WHEN lead(s) OVER w = e THEN lead(n) OVER w END AS a FROM f WINDOW w AS (PARTITION BY chrom ORDER BY s))"
    " SELECT chrom, s AS pos, n AS value, CASE WHEN n > b THEN '+' ELSE '-' END AS strand FROM x WHERE (n > b AND n > a) OR (n < b AND n < a)"
)
def find_extrema(spark, sf_dir):
    return shapes.local_extrema(inputs.events(spark, sf_dir, what="count"))


_FLAT = (
    ", r AS (SELECT chrom, pos, v, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)),"
    " g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS i FROM r), f AS (SELECT chrom, min(pos) AS s, max(pos) + 1 AS e, any_value(v) AS v FROM g GROUP BY chrom, i),"
    " x AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN lag(v) OVER w END AS b, CASE WHEN lead(s) OVER w = e THEN lead(v) OVER w END AS a FROM f WINDOW w AS (PARTITION BY chrom ORDER BY s))"
)


@query(
    _FLAT + ", m AS (SELECT chrom, s AS pos, v, row_number() OVER (PARTITION BY chrom ORDER BY v DESC, s) AS i FROM x WHERE v > b AND v > a),"
    " t(chrom, i, taken) AS (SELECT chrom, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM ch UNION ALL SELECT t.chrom, m.i, CASE WHEN len(list_filter(t.taken, lambda y: abs(y - m.pos) < 10)) > 0 THEN t.taken ELSE list_append(t.taken, m.pos) END FROM t JOIN m ON m.chrom = t.chrom AND m.i = t.i + 1),"
    " k AS (SELECT chrom, unnest(arg_max(taken, i)) AS pos FROM t GROUP BY chrom) SELECT k.chrom, k.pos, m.v AS value, '+' AS strand FROM k JOIN m ON m.chrom = k.chrom AND m.pos = k.pos"
)
def find_extrema_apart(spark, sf_dir):
    return shapes.local_extrema(_e(spark, sf_dir)[0], min_sep=10, kind="maxima")


_OUT = "SELECT chrom, pos AS start, pos + 1 AS \"end\", v AS value FROM "


@query(_OUT + "ev WHERE NOT (v < CAST(CAST(80.1 AS FLOAT) AS DOUBLE))")
def remove_less(spark, sf_dir):
    return filters.remove_threshold(_e(spark, sf_dir)[0], "less", 80.1)


@query(_OUT + "ev WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.chrom = ev.chrom AND pos >= s AND pos < e)")
def remove_mask(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return filters.remove_mask(e, inputs.mask(spark, sf_dir, e))


@query(_OUT + "ev WHERE EXISTS (SELECT 1 FROM mk WHERE mk.chrom = ev.chrom AND pos >= s AND pos < e)")
def remove_mask_inverse(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return filters.remove_mask(e, inputs.mask(spark, sf_dir, e), inverse=True)


@query("SELECT chrom, pos, coalesce(v, 0) AS value FROM d")
def fill_zero(spark, sf_dir):
    e, c = _e(spark, sf_dir)
    return dense(filters.fill(e, c, 0.0), c).select("chrom", "pos", "value")


@query(_OUT.replace("pos", "(pos + 30)") + "ev WHERE pos + 30 < 720")
def shift_pos(spark, sf_dir):
    return filters.shift(*_e(spark, sf_dir), 30)


@query(_OUT.replace("pos", "(pos - 45)") + "ev WHERE pos - 45 >= 0")
def shift_neg(spark, sf_dir):
    return filters.shift(*_e(spark, sf_dir), -45)


@query(
    ", r AS (SELECT chrom, pos, n, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(n) OVER w = n THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)),"
    " g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS i FROM r) SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\", any_value(n) AS value FROM g GROUP BY chrom, i"
)
def condense_runs(spark, sf_dir):
    return condense(inputs.events(spark, sf_dir, what="count"))


_BINS = ", h AS (SELECT CAST(trunc(v * {m}) AS BIGINT) AS bin, count(*) AS c FROM {t} GROUP BY 1) SELECT b AS bin, CAST(coalesce(c, 0) AS BIGINT) AS count FROM (SELECT unnest(range((SELECT min(bin) FROM h), (SELECT max(bin) FROM h) + 1)) AS b) LEFT JOIN h ON b = bin"
_LINES = ", l AS (SELECT l_returnflag AS chrom, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"


@query(_BINS.format(m="1", t="ev"))
def distribution(spark, sf_dir):
    return summaries.distribution(_e(spark, sf_dir)[0])


@query(_LINES + _BINS.format(m="0.1", t="l"))
def distribution_mult(spark, sf_dir):
    return summaries.distribution(inputs.lines(spark, sf_dir), 0.1)


@query("SELECT chrom, pos // 50 * 50 + (least(pos // 50 * 50 + 50, 720) - pos // 50 * 50) // 2 AS middle, round(coalesce(avg(v), 0), 9) AS mean FROM d GROUP BY chrom, pos // 50")
def chromgraph(spark, sf_dir):
    return _r(summaries.chromgraph(*_e(spark, sf_dir), 50), "mean")


def _profile(left: int, right: int, at: str, extra: str = "", first: bool = False) -> str:
    plus, minus = {
        "centre": (f"s + (e - s) // 2 - {left}", f"s + (e - s) // 2 + (e - s) % 2 - {right}"),
        "starts": (f"s - {left}", f"e - {right}"),
        "ends": (f"e - {left}", f"s - {right}"),
    }[at]
    width = left + right + first
    if first and at == "centre":
        minus += " - 1"
    label = f"o - {left}" if first else f"CASE WHEN o >= {left} THEN o - {left} + 1 ELSE o - {left} END"
    return (
        f", w AS (SELECT row_id, chrom, name, strand, CASE WHEN strand = '-' THEN {minus} ELSE {plus} END AS a FROM rg),"
        f" j AS (SELECT w.*, CAST(t.o AS BIGINT) AS o, {label} AS position, CASE WHEN strand = '-' THEN a + {width} - 1 - t.o ELSE a + t.o END AS pos FROM w CROSS JOIN range(0, {width}) t(o)),"
        f" p AS (SELECT j.*, ev.v, ev.n FROM j LEFT JOIN ev ON ev.chrom = j.chrom AND ev.pos = j.pos){extra} "
    )


def _aggregate(spark, sf_dir, left, right, **more):
    e, _ = _e(spark, sf_dir)
    return profiles.aggregate({"r": inputs.regions(spark, sf_dir, e)}, {"e": e}, left, right, **more)


_MEAN = "SELECT position, round(avg(v), 9) AS mean FROM p GROUP BY position"


@query(_profile(12, 12, "centre") + _MEAN)
def aggregate_mid(spark, sf_dir):
    return _r(_aggregate(spark, sf_dir, 12, 12), "mean").select("position", "mean")


@query(_profile(8, 15, "starts") + _MEAN)
def aggregate_starts(spark, sf_dir):
    return _r(_aggregate(spark, sf_dir, 8, 15, anchor="starts"), "mean").select("position", "mean")


@query(_profile(15, 8, "ends") + _MEAN)
def aggregate_ends(spark, sf_dir):
    return _r(_aggregate(spark, sf_dir, 15, 8, anchor="ends"), "mean").select("position", "mean")


@query(_profile(10, 10, "centre", first=True) + _MEAN)
def aggregate_firstbase(spark, sf_dir):
    return _r(_aggregate(spark, sf_dir, 10, 10, firstbase=True), "mean").select("position", "mean")


@query(
    _profile(12, 12, "centre")
    + "SELECT position, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(stddev_samp(v), 9) AS sd, count(v) AS n, round(stddev_samp(v) / sqrt(count(v)), 9) AS se,"
    " round(avg(v) - stddev_samp(v) / sqrt(count(v)), 9) AS low, round(avg(v) + stddev_samp(v) / sqrt(count(v)), 9) AS high FROM p GROUP BY position"
)
def aggregate_expanded(spark, sf_dir):
    names = ("mean", "median", "sd", "se", "low", "high")
    return _r(_aggregate(spark, sf_dir, 12, 12, expanded=True), *names).select("position", "n", *names)


@query(
    _profile(6, 6, "centre")
    + "SELECT 'all' AS region_set, x.signal, position, round(avg(CASE WHEN x.signal = 'e' THEN v ELSE n END), 9) AS mean FROM p CROSS JOIN (VALUES ('e'), ('e2')) x(signal) GROUP BY ALL"
    " UNION ALL SELECT 'minus', x.signal, position, round(avg(CASE WHEN x.signal = 'e' THEN v ELSE n END), 9) FROM p CROSS JOIN (VALUES ('e'), ('e2')) x(signal) WHERE strand = '-' GROUP BY ALL"
)
def aggregate_long(spark, sf_dir):
    e, e2 = inputs.events(spark, sf_dir), inputs.events(spark, sf_dir, what="count")
    r = inputs.regions(spark, sf_dir, e)
    return _r(profiles.aggregate({"all": r, "minus": r.where("strand = '-'")}, {"e": e, "e2": e2}, 6, 6), "mean")


@query(_profile(5, 5, "starts") + "SELECT row_id, position, v AS value FROM p")
def matrix_long(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return profiles.matrix_long(inputs.regions(spark, sf_dir, e), {"e": e}, 5, 5, "starts").select("row_id", "position", "value")


@query(_profile(8, 8, "centre") + "SELECT row_id, CASE WHEN o // 4 * 4 >= 8 THEN o // 4 * 4 - 4 ELSE o // 4 * 4 - 8 END AS position, round(avg(v), 9) AS value FROM p GROUP BY row_id, o // 4")
def matrix_tiled(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return _r(profiles.matrix_long(inputs.regions(spark, sf_dir, e), {"e": e}, 8, 8, tile=4), "value").select("row_id", "position", "value")


def _texts(values: str = "values"):
    return F.array_join(F.transform(values, lambda v: F.when(v.isNull(), "NA").otherwise(F.round(v).cast("long").cast("string"))), ",")


@query(
    _profile(5, 5, "ends")
    + "SELECT row_id, string_agg(CASE WHEN v IS NULL THEN 'NA' ELSE CAST(CAST(round(v) AS BIGINT) AS VARCHAR) END, ',' ORDER BY o) || ',' || string_agg(CASE WHEN n IS NULL THEN 'NA' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END, ',' ORDER BY o) AS vals FROM p GROUP BY row_id"
)
def matrix_fused(spark, sf_dir):
    e, e2 = inputs.events(spark, sf_dir), inputs.events(spark, sf_dir, what="count")
    return profiles.matrix(inputs.regions(spark, sf_dir, e), {"e": e, "e2": e2}, 5, 5, "ends").select("row_id", _texts().alias("vals"))


_EXTRACT = ", x AS (SELECT rg.*, CAST(t.o AS BIGINT) AS o, CASE WHEN strand = '-' THEN e - 1 - t.o ELSE s + t.o END AS pos FROM rg, range(0, 20) t(o) WHERE t.o < e - s), p AS (SELECT x.*, n FROM x LEFT JOIN ev ON ev.chrom = x.chrom AND ev.pos = x.pos) "


@query(_EXTRACT + "SELECT row_id, e - s AS length, string_agg(CASE WHEN n IS NULL THEN 'NA' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END, ',' ORDER BY o) AS vals FROM p GROUP BY ALL")
def extract_bed(spark, sf_dir):
    e = inputs.events(spark, sf_dir, what="count")
    return profiles.extract(e, inputs.regions(spark, sf_dir, e)).select("row_id", "length", _texts().alias("vals"))


@query(_EXTRACT + "SELECT chrom || ':' || (s + 1) || '-' || e AS name, CAST(o AS INTEGER) AS idx, n AS value FROM p")
def extract_jsp(spark, sf_dir):
    e = inputs.events(spark, sf_dir, what="count")
    return profiles.extract_lines(e, inputs.regions(spark, sf_dir, e), locus_name=True).select("name", "idx", "value")


def _paste(spark, sf_dir, **more):
    e, e2 = inputs.events(spark, sf_dir), inputs.events(spark, sf_dir, what="count")
    other = filters.remove_mask(e2, inputs.mask(spark, sf_dir, e2))
    return windows.paste({"a": e, "b": other}, sections_of(inputs.sizes(e, inputs.HOURS)), **more).drop("section_id")


_PASTE = ", q AS (SELECT chrom, pos, v AS a, CASE WHEN NOT EXISTS (SELECT 1 FROM mk WHERE mk.chrom = d.chrom AND pos >= s AND pos < e) THEN n END AS b FROM d) SELECT chrom, pos, a, b"


@query(_PASTE + " FROM q")
def paste(spark, sf_dir):
    return _paste(spark, sf_dir)


@query(_PASTE + " FROM q WHERE a IS NOT NULL AND b IS NOT NULL")
def paste_skip_na(spark, sf_dir):
    return _paste(spark, sf_dir, skip_na=True)


@query(_PASTE + " FROM q WHERE NOT coalesce(a < 2, false) AND NOT coalesce(b < 2, false)")
def paste_skip_min(spark, sf_dir):
    return _paste(spark, sf_dir, skip_min=2)


@query(_PASTE + ", CAST(1.5 AS DOUBLE) AS c, (SELECT round(avg(a), 9) FROM q) AS a_mean, CAST((SELECT count(a) FROM q) AS DOUBLE) AS a_covered, (SELECT round(avg(b), 9) FROM q) AS b_mean, CAST((SELECT count(b) FROM q) AS DOUBLE) AS b_covered FROM q")
def paste_consts(spark, sf_dir):
    return _r(_paste(spark, sf_dir, consts={"c": 1.5}, means=True, covs=True), "a_mean", "b_mean")


def _windows(size: int, step: int, where: str = "true", start: str = "pos", length: int | None = None) -> str:
    length = length or size
    return (
        f", f AS (SELECT chrom, pos, list(CASE WHEN n IS NULL THEN 'NA' ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS x FROM d)"
        f" SELECT chrom, {start} AS start, {start} + {length} AS \"end\", array_to_string(x, ',') AS vals FROM f WHERE len(x) = {size} AND pos % {step} = 0 AND {where}"
    )


def _window(spark, sf_dir, *a, **k):
    e = inputs.events(spark, sf_dir, what="count")
    return windows.window(e, sections_of(inputs.sizes(e, inputs.HOURS)), *a, **k).select("chrom", "start", "end", _texts().alias("vals"))


@query(_windows(8, 3))
def window(spark, sf_dir):
    return _window(spark, sf_dir, 8, 3)


@query(_windows(9, 3, start="pos + 3", length=3))
def window_center(spark, sf_dir):
    return _window(spark, sf_dir, 9, 3, centre=True)


@query(_windows(6, 1, "NOT list_contains(x, 'NA')"))
def window_skip_na(spark, sf_dir):
    return _window(spark, sf_dir, 6, skip_na=True)


def _roll(value: str, extra: str = "") -> str:
    return (
        ", f AS (SELECT chrom, pos, count(v) OVER w AS k, sum(v) OVER w AS s FROM d WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))"
        f" SELECT chrom, pos + 12 AS start, pos + 13 AS \"end\", round({value}, 9) AS value FROM f WHERE pos + 24 <= 720 AND k > 0 AND 24 - k <= 12{extra}"
    )


@query(_roll("s / k"))
def roll_mean(spark, sf_dir):
    return windows.roll(*_e(spark, sf_dir), "mean", 24).drop("section_id").withColumn("value", F.round("value", 9))


@query(_roll("s", " AND s / k >= 60"))
def roll_total(spark, sf_dir):
    return windows.roll(*_e(spark, sf_dir), "total", 24, min_mean=60).drop("section_id").withColumn("value", F.round("value", 9))


@query(
    ", m AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM ev), z AS (SELECT chrom, pos, (v - m) / sd AS z FROM ev, m)"
    " SELECT chrom, pos AS start, CAST((z >= -0.6744897501960817)::INT + (z >= 0)::INT + (z >= 0.6744897501960817)::INT AS INTEGER) AS bin,"
    " substr('ACGT', 1 + (z >= -0.6744897501960817)::INT + (z >= 0)::INT + (z >= 0.6744897501960817)::INT, 1) AS letter FROM z"
)
def sax_bins(spark, sf_dir):
    return shapes.sax(_e(spark, sf_dir)[0], 4).select("chrom", "start", "bin", "letter")


_LIFT = (
    ", c AS (SELECT chrom, r_regionkey * 140 AS t0, r_regionkey * 140 + CASE WHEN r_regionkey = 2 THEN 150 ELSE 120 END AS t1, 1000 + r_regionkey * 50 AS q0, r_regionkey % 2 = 1 AS minus FROM region CROSS JOIN ch),"
    " m AS (SELECT ev.chrom, pos, any_value(v) AS v, count(t0) AS k, min(CASE WHEN minus THEN 1999 - (q0 + pos - t0) ELSE q0 + pos - t0 END) AS q FROM ev LEFT JOIN c ON c.chrom = ev.chrom AND pos >= t0 AND pos < t1 GROUP BY ev.chrom, pos),"
    " o AS (SELECT *, count(*) OVER (PARTITION BY chrom, q) AS n FROM m WHERE k = 1)"
)


@query(_LIFT + " SELECT chrom, CAST(q AS BIGINT) AS start, CAST(q + 1 AS BIGINT) AS \"end\", v AS value FROM o WHERE n = 1")
def lift_signal(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return lift(e, inputs.chain(spark, sf_dir, e))[0]


@query(_LIFT + " SELECT chrom, pos, CASE WHEN k = 0 THEN 'deleted' ELSE 'duplicated' END AS reason FROM m WHERE k <> 1 UNION ALL SELECT chrom, pos, 'multi_mapped' FROM o WHERE n > 1")
def lift_unlifted(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return lift(e, inputs.chain(spark, sf_dir, e))[1].select("chrom", "pos", "reason")


_CLOSED = "(q.gap + r.have + q.e - q.s > 500 AND (q.gap >= 3 OR q.chrom <> r.chrom))"


@query(
    ", u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS chrom, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS BIGINT) AS pos FROM events),"
    " y AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM u), z AS (SELECT chrom, min(pos) AS s, max(pos) + 1 AS e FROM y GROUP BY chrom, k),"
    " q AS (SELECT *, CASE WHEN lag(chrom) OVER o = chrom THEN s - lag(e) OVER o ELSE 0 END AS gap, row_number() OVER o AS i FROM z WINDOW o AS (ORDER BY chrom, s)),"
    # a row for each stretch: the chunk it is in, and what was closed before it
    " r(i, chrom, s, e, have, chunk, c_chrom, c_s, c_e, c_chunk) AS (SELECT i, chrom, s, e, e - s, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), s, e, CAST(0 AS BIGINT) FROM q WHERE i = 1 UNION ALL"
    f" SELECT q.i, q.chrom, CASE WHEN {_CLOSED} OR q.chrom <> r.chrom THEN q.s ELSE r.s END, q.e, CASE WHEN {_CLOSED} THEN q.e - q.s ELSE r.have + q.gap + q.e - q.s END, CASE WHEN {_CLOSED} THEN r.chunk + 1 ELSE r.chunk END,"
    f" CASE WHEN {_CLOSED} OR q.chrom <> r.chrom THEN r.chrom END, r.s, r.e, r.chunk FROM r JOIN q ON q.i = r.i + 1)"
    " SELECT c_chunk AS chunk, c_chrom AS chrom, c_s AS start, c_e AS \"end\" FROM r WHERE c_chrom IS NOT NULL UNION ALL (SELECT chunk, chrom, s, e FROM r ORDER BY i DESC LIMIT 1)"
)
def split_chunks(spark, sf_dir):
    return shapes.split_chunks(inputs.events(spark, sf_dir, chrom="user_id"), 500, 3)


_EIGHTHS = " + ".join(f"(z >= {NormalDist().inv_cdf(i / 8)!r})::INT" for i in range(1, 8))


@query(
    ", m AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM ev), z AS (SELECT chrom, pos, (v - m) / sd AS z, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM ev, m)"
    f" SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\", string_agg(substr('ACGTVLIM', 1 + {_EIGHTHS}, 1), '' ORDER BY pos) AS word FROM z GROUP BY chrom, g"
)
def sax_words(spark, sf_dir):
    return shapes.sax_words(*_e(spark, sf_dir), 8)


@query(
    ", m AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM ev), g AS (SELECT chrom, pos, v, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM ev),"
    " i AS (SELECT chrom, g, v, min(pos) OVER o AS s, max(pos) OVER o + 1 AS e, (pos - min(pos) OVER o) // 4 AS i FROM g WINDOW o AS (PARTITION BY chrom, g)),"
    f" z AS (SELECT chrom, s, e, i, (avg(v) - any_value(m)) / any_value(sd) AS z FROM i, m GROUP BY ALL)"
    f" SELECT chrom, s AS start, e AS \"end\", string_agg(substr('ACGTVLIM', 1 + {_EIGHTHS}, 1), '' ORDER BY i) AS word FROM z GROUP BY chrom, s, e"
)
def sax_words_window(spark, sf_dir):
    return shapes.sax_words(*_e(spark, sf_dir), 8, window=4)


@query(
    "SELECT rg.chrom, s AS start, name, count(v) AS num_data, round(quantile_cont(v, 0.1), 9) AS q10, round(quantile_cont(v, 0.25), 9) AS q25, round(quantile_cont(v, 0.5), 9) AS median, "
    f"round(quantile_cont(v, 0.75), 9) AS q75, round(quantile_cont(v, 0.9), 9) AS q90 {_REGION} GROUP BY ALL"
)
def summary_quantiles_long(spark, sf_dir):
    """As summary_quantiles, with regions of more than 12 bases taken as long."""
    e, _ = _e(spark, sf_dir)
    q = ("q10", "q25", "median", "q75", "q90")
    return _r(summaries.summary(e, inputs.regions(spark, sf_dir, e).drop("row_id", "strand"), quantiles=True, long=12), *q).select("chrom", "start", "name", "num_data", *q)


@query(None)
def matrix_cluster(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return profiles.cluster(profiles.matrix(inputs.regions(spark, sf_dir, e), {"e": e}, 5, 5, fill=0.0), 3)[0].select("row_id", "label", "distance")


@query("SELECT count(*) AS regions, count(*) AS nearest, CAST(3 AS BIGINT) AS clusters FROM rg")
def matrix_cluster_nearest(spark, sf_dir):
    """What must hold of the clusters wherever their seeds lie: each region is in one, at the distance of the centre nearest to it."""
    e, _ = _e(spark, sf_dir)
    vectors = profiles.matrix(inputs.regions(spark, sf_dir, e), {"e": e}, 5, 5, fill=0.0)
    found, centres = profiles.cluster(vectors, 3)
    far = [F.sqrt(F.aggregate(F.zip_with("values", F.array(*(F.lit(float(x)) for x in c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x)) for c in centres]
    both = found.select("row_id", "label", "distance").join(vectors.select("row_id", "values"), "row_id")
    near = F.abs(F.col("distance") - F.least(*far)) < 1e-6
    return both.agg(F.count("*").alias("regions"), F.count_if(near).alias("nearest"), F.countDistinct("label").alias("clusters"))


_HOLDS = (
    ", w AS (SELECT chrom, pos, count(v) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS k FROM d),"
    " ok AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS g FROM w WHERE pos + 15 <= 720 AND 15 - k <= 12 AND NOT EXISTS (SELECT 1 FROM mk WHERE mk.chrom = w.chrom AND pos < e AND pos + 15 > s))"
)


@query(_HOLDS + " SELECT chrom, min(pos) AS start, max(pos) + 1 AS \"end\" FROM ok GROUP BY chrom, g")
def random_places(spark, sf_dir):
    e, c = _e(spark, sf_dir)
    return merge(shapes.random_places(e, c, 15, 0.8, blacklist=inputs.mask(spark, sf_dir, e)))


@query(_HOLDS + " SELECT CAST(20 AS BIGINT) AS regions, CAST(20 AS BIGINT) AS places, CAST(20 AS BIGINT) AS allowed, CAST(15 AS BIGINT) AS shortest, CAST(15 AS BIGINT) AS longest, (SELECT count(*) FROM ok) > 20 AS room")
def random_regions(spark, sf_dir):
    """Drawn by hashes, so SQL can only tell what must hold of them: number, distinct places, allowed places, sizes."""
    e, c = _e(spark, sf_dir)
    mask = inputs.mask(spark, sf_dir, e)
    found = shapes.random_regions(e, c, 20, 15, 0.8, blacklist=mask)
    # allowed: gaps and blacklist, counted anew from bases
    kept = bases(found.select("chrom", F.col("start").alias("at"), "start", "end"))
    have = kept.join(e.select("chrom", F.col("start").alias("pos"), F.lit(1).alias("v")), ["chrom", "pos"], "left")
    barred = bases(mask).select("chrom", "pos", F.lit(1).alias("m")).distinct()
    facts = have.join(barred, ["chrom", "pos"], "left").groupBy("chrom", "at").agg(F.count("v").alias("v"), F.count("m").alias("m"))
    allowed = facts.where("15 - v <= 12 and m = 0").agg(F.count("*").alias("allowed"))
    size = F.col("end") - F.col("start")
    one = found.agg(F.count("*").alias("regions"), F.countDistinct("chrom", "start").alias("places"), F.min(size).alias("shortest"), F.max(size).alias("longest"), (F.count("*") == 20).alias("room"))
    return one.crossJoin(allowed)


_LAGS = ", m AS (SELECT avg(v) AS m FROM ev), x AS (SELECT chrom, pos, v - m AS x FROM ev, m), k AS (SELECT CAST(unnest(range(0, 31)) AS BIGINT) AS lag)"


@query(
    _LAGS + ", s AS (SELECT lag, count(*) AS n, avg(a.x * b.x) AS c FROM k JOIN x a ON true JOIN x b ON b.chrom = a.chrom AND b.pos = a.pos + lag GROUP BY lag)"
    " SELECT lag, n, round(c, 6) AS covariance, round(c / (SELECT c FROM s WHERE lag = 0), 9) AS correlation FROM s"
)
def autocorrelation(spark, sf_dir):
    out = windows.autocorrelation(*_e(spark, sf_dir), 30)
    return out.select("lag", "n", F.round("covariance", 6).alias("covariance"), F.round("correlation", 9).alias("correlation"))


@query(
    ", b AS (SELECT rg.*, CAST(t.o AS BIGINT) AS o, CASE WHEN strand = '-' THEN e - 1 - t.o ELSE s + t.o END AS pos FROM rg, range(0, 20) t(o) WHERE t.o < e - s),"
    " body AS (SELECT row_id, CAST(floor(o * 10 / (e - s)) AS BIGINT) + 5 AS c, avg(v) AS x FROM b JOIN ev ON ev.chrom = b.chrom AND ev.pos = b.pos GROUP BY ALL),"
    " side AS (SELECT rg.chrom, CAST(t.o AS BIGINT) AS c, CASE WHEN strand = '-' THEN e + 4 - t.o ELSE s - 5 + t.o END AS pos FROM rg, range(0, 5) t(o)"
    " UNION ALL SELECT rg.chrom, CAST(t.o AS BIGINT) + 15, CASE WHEN strand = '-' THEN s - 1 - t.o ELSE e + t.o END FROM rg, range(0, 5) t(o)),"
    " k AS (SELECT c, x FROM body UNION ALL SELECT c, v FROM side JOIN ev ON ev.chrom = side.chrom AND ev.pos = side.pos) SELECT c AS \"offset\", round(avg(x), 9) AS mean FROM k GROUP BY c"
)
def aggregate_meta(spark, sf_dir):
    e, _ = _e(spark, sf_dir)
    return profiles.meta_vectors(inputs.regions(spark, sf_dir, e), e, 5, 10, 5).groupBy("offset").agg(F.round(F.avg("value"), 9).alias("mean"))
