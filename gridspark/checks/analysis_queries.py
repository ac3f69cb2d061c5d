"""Queries of outliers, scaling, derived features, temporal filters and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.checks.fixtures import GRID_VARS, view
from gridspark.checks.registry import on_view, query, rounded
from gridspark.functions.frames import COORDS
from gridspark.operators import derive, labels, outliers, scaling, stats, temporal
from gridspark.operators.align import densify
from gridspark.operators.series import in_blocks
from gridspark.plans.cleaning import written

POS = "time, lat, lon"
PAIR = ("chl", "sst")


def _pick(df: DataFrame, *cols: str) -> DataFrame:
    return rounded(df.select(*COORDS, *cols), cols)


def _q(v: str, p: float, source: str = "grid") -> str:
    return f"(SELECT quantile_cont({v}, {p}) FROM {source})"


# ---------------------------------------------------------------- outliers

def _outlier_line(v: str, test: str, bounds: bool) -> str:
    low, high = (f"quantile_cont({v}, 0.01)", f"quantile_cont({v}, 0.99)") if bounds else ("NULL", "NULL")
    return f"""SELECT '{v}' AS var, count(*) FILTER ({test}) AS outlier_count,
  round(100.0 * count(*) FILTER ({test}) / count({v}), 6) AS outlier_pct,
  round(CAST({low} AS DOUBLE), 6) AS lower_bound, round(CAST({high} AS DOUBLE), 6) AS upper_bound FROM grid"""


def _fence(v: str, k: float, side: str) -> str:
    q1, q3 = _q(v, 0.25), _q(v, 0.75)
    return f"({q1} - {k} * ({q3} - {q1}))" if side == "low" else f"({q3} + {k} * ({q3} - {q1}))"


def _outside(v: str, k: float) -> str:
    return f"({v} < {_fence(v, k, 'low')} OR {v} > {_fence(v, k, 'high')})"


def _detected(method: str, k: float):
    def run(d: DataFrame) -> DataFrame:
        return rounded(outliers.detect_outliers(d, ["chl", "kd490", "zsd"], method, k),
                       ("outlier_pct", "lower_bound", "upper_bound"))
    return run


on_view("out_1", "grid", _detected("iqr", 1.5), " UNION ALL ".join(
    _outlier_line(v, _outside(v, 1.5), True) for v in ("chl", "kd490", "zsd")))
on_view("out_2", "grid", _detected("zscore", 2.0), " UNION ALL ".join(
    _outlier_line(v, f"abs(({v} - (SELECT avg({v}) FROM grid)) / (SELECT stddev_pop({v}) FROM grid)) > 2.0", False)
    for v in ("chl", "kd490", "zsd")))
on_view("out_3", "grid", _detected("modified_zscore", 2.5), " UNION ALL ".join(
    _outlier_line(v, f"abs(0.6745 * ({v} - {_q(v, 0.5)}) / ((SELECT quantile_cont(abs({v} - {_q(v, 0.5)}), 0.5) FROM grid) + 1e-10)) > 2.5", False)
    for v in ("chl", "kd490", "zsd")))


def _clip(v: str, a: float, b: float) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN round(greatest(least({v}, {_q(v, b)}), {_q(v, a)}), 6) END AS {v}"


on_view("out_4", "grid", lambda d: _pick(outliers.clip_outliers(d, PAIR), *PAIR),
        f"SELECT {POS}, {', '.join(_clip(v, 0.01, 0.99) for v in PAIR)} FROM grid")
on_view("out_5", "grid", lambda d: _pick(outliers.winsorize(d, PAIR), *PAIR),
        f"SELECT {POS}, {', '.join(_clip(v, 0.05, 0.95) for v in PAIR)} FROM grid")
on_view("out_6", "grid", lambda d: _pick(outliers.impute_outliers(d, PAIR, 1.0), *PAIR), f"SELECT {POS}, " + ", ".join(
    f"round(CASE WHEN {_outside(v, 1.0)} THEN {_q(v, 0.5)} ELSE {v} END, 6) AS {v}" for v in PAIR) + " FROM grid")
on_view("out_7", "grid", lambda d: outliers.drop_outliers(d, PAIR, 1.0).select(*COORDS, *PAIR),
        f"SELECT {POS}, chl, sst FROM grid WHERE NOT {_outside('chl', 1.0)} AND NOT {_outside('sst', 1.0)}")


# ---------------------------------------------------------------- scaling

def _scaled(method: str, **kw):
    return lambda d: _pick(scaling.scale(d, PAIR, method, **kw), *PAIR)


def _scale_sql(form: str) -> str:
    return f"SELECT {POS}, " + ", ".join(f"round({form.format(v=v)}, 6) AS {v}" for v in PAIR) + " FROM grid"


on_view("sc_1", "grid", _scaled("standard"),
        _scale_sql("({v} - (SELECT avg({v}) FROM grid)) / ((SELECT stddev_pop({v}) FROM grid) + 1e-10)"))
on_view("sc_2", "grid", _scaled("minmax", bounds=(-1.0, 1.0)), _scale_sql(
    "({v} - (SELECT min({v}) FROM grid)) / ((SELECT max({v}) FROM grid) - (SELECT min({v}) FROM grid)) * 2 - 1"))
on_view("sc_3", "grid", _scaled("robust"), _scale_sql(
    "({v} - (SELECT quantile_cont({v}, 0.5) FROM grid)) / ((SELECT quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) FROM grid) + 1e-10)"))


@query("sc_4", f"""
WITH c AS (SELECT {POS}, chl - 3 AS chl, sst FROM grid)
SELECT {POS}, round(ln(1 + chl + CASE WHEN (SELECT min(chl) FROM c) <= 0 THEN 1 - (SELECT min(chl) FROM c) ELSE 0 END), 6) AS chl,
  round(ln(1 + sst + CASE WHEN (SELECT min(sst) FROM c) <= 0 THEN 1 - (SELECT min(sst) FROM c) ELSE 0 END), 6) AS sst FROM c""")
def sc_4(spark: SparkSession, folder: str) -> DataFrame:
    shifted = view(spark, folder, "grid").withColumn("chl", F.col("chl") - 3)
    return _pick(scaling.scale(shifted, PAIR, "log"), *PAIR)


@query("sc_5", f"""
SELECT {POS}, round(sign(chl - 3) * sqrt(abs(chl - 3)), 6) AS chl, round(sqrt(sst), 6) AS sst FROM grid""")
def sc_5(spark: SparkSession, folder: str) -> DataFrame:
    shifted = view(spark, folder, "grid").withColumn("chl", F.col("chl") - 3)
    return _pick(scaling.scale(shifted, PAIR, "power"), *PAIR)


TRAIN = "(SELECT * FROM grid WHERE time < DATE '1996-01-01')"


@query("sc_6", f"SELECT {POS}, " + ", ".join(
    f"round(({v} - (SELECT avg({v}) FROM {TRAIN})) / (SELECT stddev_pop({v}) FROM {TRAIN}), 6) AS {v}" for v in PAIR)
    + " FROM grid WHERE time >= DATE '1996-01-01'")
def sc_6(spark: SparkSession, folder: str) -> DataFrame:
    grid = view(spark, folder, "grid")
    params = scaling.fit_scaler(grid.where("time < DATE '1996-01-01'"), PAIR)
    return _pick(scaling.apply_scaler(grid.where("time >= DATE '1996-01-01'"), params, PAIR), *PAIR)


# ---------------------------------------------------------------- derived features

def _column(name: str, make, sql: str, out: str = "double") -> None:
    """One derived column over the grid."""
    def run(d: DataFrame) -> DataFrame:
        c = make()
        return d.select(*COORDS, c.alias("value"))
    text = sql if out == "double" else f"CAST({sql} AS INT)"
    on_view(name, "grid", run, f"SELECT {POS}, {text} AS value FROM grid")


DOY = "dayofyear(time)"
_column("df_1", derive.euphotic_depth, "4.605 / kd490")
_column("df_2", derive.euphotic_depth_clipped,
        "CASE WHEN kd490 = 0 THEN 200.0 WHEN kd490 IS NULL OR 4.605 / kd490 <= 0 THEN 0.0 WHEN 4.605 / kd490 < 200 THEN 4.605 / kd490 ELSE 200.0 END")
_column("df_3", derive.specific_absorption, "kd490 / (chl + 0.01)")
_column("df_4", derive.clarity_index, "1 / (zsd + 0.1)")
_column("df_5", derive.current_energy, "0.5 * current_speed * current_speed")
on_view("df_6", "grid", lambda d: _pick(derive.ts_gradient(densify(d)), "ts_gradient_magnitude"), f"""
SELECT {POS}, round(sqrt((sst - lag(sst) OVER w)**2 + (sss - lag(sss) OVER w)**2), 6) AS ts_gradient_magnitude
FROM dense WINDOW w AS (PARTITION BY lat, lon ORDER BY time)""")


def _gradient(v: str, dim: str, other: str) -> str:
    w = f"OVER (PARTITION BY time, {other} ORDER BY {dim})"
    b, f, hs, hd = f"lag({v}) {w}", f"lead({v}) {w}", f"({dim} - lag({dim}) {w})", f"(lead({dim}) {w} - {dim})"
    return (f"round(CASE WHEN {hs} IS NULL THEN ({f} - {v}) / {hd} WHEN {hd} IS NULL THEN ({v} - {b}) / {hs} "
            f"ELSE ({f} - {b}) / (2 * {hs}) END, 6) AS {v}_{dim}_gradient")


GRADIENT_COLS = [f"{v}_{d}_gradient" for v in ("chl", "sst", "kd490") for d in ("lat", "lon")]
on_view("df_7", "grid", lambda d: _pick(derive.spatial_gradients(densify(d)), *GRADIENT_COLS), f"SELECT {POS}, " + ", ".join(
    [_gradient(v, "lat", "lon") for v in ("chl", "sst", "kd490")] + [_gradient(v, "lon", "lat") for v in ("chl", "sst", "kd490")]) + " FROM dense")
on_view("df_8", "grid", lambda d: d.select(*COORDS, derive.day_of_year().alias("day_of_year"), derive.month().alias("month")),
        f"SELECT {POS}, CAST({DOY} AS INT) AS day_of_year, CAST(month(time) AS INT) AS month FROM grid")
on_view("df_9", "grid", lambda d: _pick(d.withColumns({
    "season_sin": derive.season_sin(derive.day_of_year()), "season_cos": derive.season_cos(derive.day_of_year())}),
    "season_sin", "season_cos"), f"""
SELECT {POS}, round(sin(2 * pi() * {DOY} / 365.25), 6) AS season_sin, round(cos(2 * pi() * {DOY} / 365.25), 6) AS season_cos FROM grid""")
_column("df_10", derive.season, "(month(time) % 12 + 3) // 3", "int")
_column("df_11", derive.abs_latitude, "abs(lat)")
_column("df_12", lambda: F.try_divide(F.col("chl"), derive.euphotic_depth() + 0.1), "chl / (4.605 / kd490 + 0.1)")
on_view("df_13", "grid", lambda d: d.select(*COORDS, derive.productivity().alias("vgpm"), derive.productivity("cafe").alias("cafe")),
        f"SELECT {POS}, chl * 1000 AS vgpm, chl * sst * 50 AS cafe FROM grid")
CROSS = {"chl_kd490_interaction": "chl * kd490", "chl_euphotic_depth_interaction": "chl * euphotic_depth",
         "sst_chl_interaction": "sst * chl", "current_speed_chl_interaction": "current_speed * chl"}
on_view("df_14", "grid", lambda d: derive.interactions(
    d.withColumn("euphotic_depth", derive.euphotic_depth())).select(*COORDS, *CROSS),
        f"SELECT {POS}, " + ", ".join(f"{e} AS {n}" for n, e in CROSS.items())
        + " FROM (SELECT *, 4.605 / kd490 AS euphotic_depth FROM grid)")
POWERS = [f"{v}_{p}" for v in ("chl", "kd490", "sst") for p in ("squared", "cubic")]
on_view("df_15", "grid", lambda d: derive.polynomials(d).select(*COORDS, *POWERS), f"SELECT {POS}, " + ", ".join(
    f"{v} * {v} AS {v}_squared, {v} * {v} * {v} AS {v}_cubic" for v in ("chl", "kd490", "sst")) + " FROM grid")

DEPTH = "CASE WHEN kd490 IS NULL THEN 0.0 WHEN 4.605 / kd490 < 200 THEN 4.605 / kd490 ELSE 200.0 END"
CALENDAR = (f"CAST({DOY} AS INT) AS day_of_year, CAST(month(time) AS INT) AS month, "
            "CAST((month(time) % 12 + 3) // 3 AS INT) AS season, abs(lat) AS abs_latitude")
on_view("df_16", "grid", lambda d: derive.feature_dataset(d.drop("pp")),
        f"SELECT {POS}, chl, kd490, zsd, sst, sss, {DEPTH} AS euphotic_depth, chl * 1000 AS pp, {CALENDAR} FROM grid")
on_view("df_17", "grid", lambda d: derive.ml_table(derive.feature_dataset(d), "pp", derive.SHORT_FEATURES, True, True), f"""
SELECT {POS}, chl, kd490, zsd, euphotic_depth, day_of_year, month, season, abs_latitude, pp,
  chl * kd490 AS chl_kd490_interaction, chl * euphotic_depth AS chl_euphotic_depth_interaction,
  chl * chl AS chl_squared, chl * chl * chl AS chl_cubic, kd490 * kd490 AS kd490_squared, kd490 * kd490 * kd490 AS kd490_cubic
FROM (SELECT *, {DEPTH} AS euphotic_depth, {CALENDAR} FROM grid) WHERE chl IS NOT NULL AND kd490 IS NOT NULL AND pp IS NOT NULL""")


# ---------------------------------------------------------------- temporal filters

SMOOTH = ("chl", "zsd")
FRAME = "OVER (PARTITION BY lat, lon ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
on_view("win_1", "grid", lambda d: _pick(temporal.moving_avg(densify(d), SMOOTH), *SMOOTH), f"SELECT {POS}, " + ", ".join(
    f"round(CASE WHEN count({v}) {FRAME} = 7 THEN avg({v}) {FRAME} END, 6) AS {v}" for v in SMOOTH) + " FROM dense")

INNER = ([-2, 3, 6, 7, 6, 3, -2], 21)
ENDS = [([32, 15, 3, -4, -6, -3, 5], 42), ([5, 4, 3, 2, 1, 0, -1], 14), ([1, 3, 4, 4, 3, 1, -2], 14)]


def _weighted(v: str, weights: tuple[list[int], int], start: int) -> str:
    """Weighted sum of the seven values from ``start`` rows away on."""
    w = "OVER (PARTITION BY {keys} ORDER BY time)"
    at = lambda k: v if k == 0 else (f"lead({v}, {k}) {w}" if k > 0 else f"lag({v}, {-k}) {w}")
    return "(" + " + ".join(f"{c} * {at(start + i)}" for i, c in enumerate(weights[0])) + f") / CAST({weights[1]} AS DOUBLE)"


def _savgol(v: str, keys: str, digits: int = 6) -> str:
    cases = "".join(f"WHEN rn = {i + 1} THEN {_weighted(v, ENDS[i], -i)} " for i in range(3))
    cases += "".join(f"WHEN n - rn = {i} THEN {_weighted(v, (ENDS[i][0][::-1], ENDS[i][1]), i - 6)} " for i in range(3))
    return f"round(CASE {cases} ELSE {_weighted(v, INNER, -3)} END, {digits}) AS {v}".replace("{keys}", keys)


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY time) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM {s})"
on_view("win_2", "grid", lambda d: _pick(temporal.savgol(densify(d), SMOOTH), *SMOOTH),
        f"SELECT {POS}, {', '.join(_savgol(v, 'lat, lon') for v in SMOOTH)} FROM " + NUMBERED.format(k="lat, lon", s="dense"))
# blocks of ten rows, so that the few long series are cut
on_view("win_2_series", "series", lambda d: rounded(in_blocks(
    d.withColumn("v", F.coalesce("v", F.lit(0.0))), lambda x, keys: temporal.savgol(x, ["v"], cell=keys), 6,
    cell=("cell",), block_rows=10), ["v"]),
    f"SELECT cell, time, {_savgol('v', 'cell')} FROM "
    + NUMBERED.format(k="cell", s="(SELECT cell, time, COALESCE(v, 0.0) AS v FROM series)"))
on_view("win_3", "grid", lambda d: _pick(temporal.median_filter(densify(d), SMOOTH), *SMOOTH), f"SELECT {POS}, " + ", ".join(
    f"""round(CASE WHEN count({v}) {FRAME} = count(*) {FRAME} THEN list_sort(list_concat(list({v}) {FRAME},
    list_slice([CAST(0 AS DOUBLE), 0, 0], 1, 7 - count(*) {FRAME})))[4] END, 6) AS {v}""" for v in SMOOTH) + " FROM dense")
on_view("win_4", "grid", lambda d: _pick(temporal.ewm(densify(d), SMOOTH), *SMOOTH), f"""
WITH s AS {NUMBERED.format(k="lat, lon", s="dense")}
SELECT a.time, a.lat, a.lon, """ + ", ".join(
    f"round(sum(b.{v} * pow(0.75, a.rn - b.rn)) / sum(CASE WHEN b.{v} IS NOT NULL THEN pow(0.75, a.rn - b.rn) END), 6) AS {v}" for v in SMOOTH)
    + " FROM s a JOIN s b ON a.lat = b.lat AND a.lon = b.lon AND b.rn <= a.rn GROUP BY a.time, a.lat, a.lon")
on_view("win_5", "grid", lambda d: _pick(temporal.diff_time(densify(d), SMOOTH), "chl_diff", "zsd_diff"), f"""
SELECT {POS}, round(chl - lag(chl) OVER w, 6) AS chl_diff, round(zsd - lag(zsd) OVER w, 6) AS zsd_diff
FROM dense WINDOW w AS (PARTITION BY lat, lon ORDER BY time)""")


def _axis(d: str, num: str) -> str:
    return f"""SELECT '{d}' AS dim, count(*) AS steps, arg_min(g, x) FILTER (g IS NOT NULL) AS first_gap, min(g) AS min_gap, max(g) AS max_gap
FROM (SELECT x, lead(x) OVER (ORDER BY x) - x AS g FROM (SELECT DISTINCT {num} AS x FROM grid))"""


on_view("win_6", "grid", lambda d: temporal.axis_regularity(d), f"""
SELECT *, COALESCE(greatest(abs(min_gap - first_gap), abs(max_gap - first_gap)) <= 1e-8 + 1e-3 * abs(first_gap), TRUE) AS uniform FROM (
{_axis("time", "CAST(date_diff('day', DATE '1970-01-01', time) AS DOUBLE)")} UNION ALL {_axis("lat", "lat")} UNION ALL {_axis("lon", "lon")})""")
on_view("win_7", "grid", lambda d: temporal.latest(d).select(*COORDS, *SMOOTH), f"""
SELECT {POS}, chl, zsd FROM (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY time DESC) AS rn FROM grid) WHERE rn = 1""")


@query("win_8", "SELECT id, level, ts FROM scored ORDER BY ts DESC, id DESC LIMIT 100")
def win_8(spark: SparkSession, folder: str) -> DataFrame:
    from gridspark.operators.filters import recent
    return recent(labels.score_rules(view(spark, folder, "samples")), 100).select("id", "level", "ts")


# Coefficients of a published rational approximation of the normal quantile (error below 1.2e-9).
QQ_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QQ_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QQ_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QQ_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(coefficients: Sequence[float], x: str) -> str:
    text = f"{coefficients[0]:e}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


QQ_TAIL = f"{_poly(QQ_C, 't')} / {_poly(QQ_D, 't')}"
on_view("win_9", "series", lambda d: rounded(temporal.qq_points(d, "v"), ("theoretical", "value", "slope", "intercept", "r"), 5), f"""
WITH ranked AS (SELECT row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, v FROM series WHERE v IS NOT NULL),
placed AS (SELECT i, v, CASE WHEN i = n THEN pow(CAST(0.5 AS DOUBLE), 1.0 / n) WHEN i = 1 THEN 1 - pow(CAST(0.5 AS DOUBLE), 1.0 / n)
  ELSE (i - CAST(0.3175 AS DOUBLE)) / (n + CAST(0.365 AS DOUBLE)) END AS p FROM ranked),
parts AS (SELECT i, v, p, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM placed),
spots AS (SELECT i, v, CASE WHEN p < 0.02425 THEN {QQ_TAIL} WHEN p > 0.97575 THEN -({QQ_TAIL}) ELSE {_poly(QQ_A, 'r')} * q / {_poly(QQ_B, 'r')} END AS z FROM parts),
line AS (SELECT regr_slope(v, z) AS slope, regr_intercept(v, z) AS intercept, corr(v, z) AS r FROM spots)
SELECT i, round(z, 5) AS theoretical, round(v, 5) AS value, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(r, 5) AS r FROM spots, line""")


# ---------------------------------------------------------------- statistics

def _profile(v: str) -> str:
    return (f"SELECT '{v}' AS var, count(*) - count({v}) AS null_count, round(100.0 * (count(*) - count({v})) / count(*), 6) AS null_pct, "
            f"'double' AS dtype, FALSE AS has_fill_value FROM grid")


on_view("agg_1", "grid", lambda d: rounded(stats.profile_nulls(d), ["null_pct"]), " UNION ALL ".join(_profile(v) for v in GRID_VARS))
STAT_COLS = ("mean", "std", "min", "max", "median")


def _stat(v: str) -> str:
    return (f"SELECT '{v}' AS var, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(min({v}), 6) AS min, "
            f"round(max({v}), 6) AS max, round(quantile_cont({v}, 0.5), 6) AS median, count({v}) < count(*) AS has_null, "
            "CAST(NULL AS DOUBLE) AS valid_min, CAST(NULL AS DOUBLE) AS valid_max FROM grid")


on_view("agg_2", "grid", lambda d: rounded(stats.profile_stats(written(d, "grid")), STAT_COLS), " UNION ALL ".join(_stat(v) for v in GRID_VARS))


def _out_pct(v: str) -> str:
    return f"SELECT '{v}' AS var, 100.0 * count(*) FILTER ({_outside(v, 3.0).replace('grid', 'marked')}) / count({v}) AS p FROM marked"


@query("agg_3", f"""
WITH marked AS (SELECT time, lat, lon, CASE WHEN (lat + lon) % 3 = 0 THEN chl END AS chl,
  CASE WHEN lat = 20 OR lat = 21 THEN kd490 + 1000 ELSE kd490 END AS kd490, pp, zsd FROM grid),
gaps AS (SELECT x, lead(x) OVER (ORDER BY x) - x AS g FROM (SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', time) AS DOUBLE) AS x FROM marked))
SELECT 'warning' AS severity, 'null_pct' AS rule, 'chl' AS var, round(100.0 * (count(*) - count(chl)) / count(*), 6) AS value FROM marked
UNION ALL SELECT 'warning', 'outlier_pct', var, round(p, 6) FROM ({" UNION ALL ".join(_out_pct(v) for v in ("chl", "kd490", "zsd", "pp"))}) WHERE p > 10
UNION ALL SELECT 'warning', 'irregular_axis', 'time', round(max(g) - min(g), 6) FROM gaps""")
def agg_3(spark: SparkSession, folder: str) -> DataFrame:
    marked = view(spark, folder, "grid").select(
        *COORDS, F.when((F.col("lat") + F.col("lon")) % 3 == 0, F.col("chl")).alias("chl"),
        F.when(F.col("lat").isin(20.0, 21.0), F.col("kd490") + 1000).otherwise(F.col("kd490")).alias("kd490"), "pp", "zsd")
    return rounded(stats.validate(marked), ["value"])


on_view("agg_4", "grid", lambda d: rounded(stats.quality_checks(
    d, ["chl", "pp", "kd490", "oxygen"], ("1992-01-01", "1999-12-31"), {"lat": (18.4, 30.1), "lon": (-98.0, -81.1)}), ["value"]), """
WITH m AS (SELECT count(*) AS n, count(chl) AS chl, count(pp) AS pp, count(kd490) AS kd490, min(time) AS t0, max(time) AS t1, min(lat) AS y0,
  max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM grid),
req AS (SELECT unnest(['time', 'lat', 'lon', 'chl', 'pp', 'kd490', 'oxygen']) AS s),
v AS (SELECT 'chl' AS s, chl / n AS share FROM m UNION ALL SELECT 'pp', pp / n FROM m UNION ALL SELECT 'kd490', kd490 / n FROM m)
SELECT 'required' AS rule, s AS subject, CAST(CASE WHEN s = 'oxygen' THEN 0 ELSE 1 END AS DOUBLE) AS value, s <> 'oxygen' AS passed FROM req
UNION ALL SELECT 'min_valid_ratio', s, round(share, 6), share >= 0.3 FROM v
UNION ALL SELECT 'max_null_pct', s, round((1 - share) * 100, 6), (1 - share) * 100 <= 70 FROM v
UNION ALL SELECT 'time_range', 'time', CAST(t0 >= DATE '1992-01-01' AND t1 <= DATE '1999-12-31' AS DOUBLE), t0 >= DATE '1992-01-01' AND t1 <= DATE '1999-12-31' FROM m
UNION ALL SELECT 'space_range', 'lat', CAST(y0 >= 18.4 AND y1 <= 30.1 AS DOUBLE), y0 >= 18.4 AND y1 <= 30.1 FROM m
UNION ALL SELECT 'space_range', 'lon', CAST(x0 >= -98.0 AND x1 <= -81.1 AS DOUBLE), x0 >= -98.0 AND x1 <= -81.1 FROM m""")


@query("agg_5", """
SELECT time, round(avg(chl), 6) AS mean, round(quantile_cont(chl, 0.5), 6) AS median, round(COALESCE(sum(chl), 0), 6) AS sum,
  min(chl) AS min, max(chl) AS max FROM grid GROUP BY time""")
def agg_5(spark: SparkSession, folder: str) -> DataFrame:
    grid = view(spark, folder, "grid")
    out = stats.spatial_series(grid, "chl", "mean").withColumnRenamed("chl", "mean")
    for how in ("median", "sum", "min", "max"):
        out = out.join(stats.spatial_series(grid, "chl", how).withColumnRenamed("chl", how), "time")
    return rounded(out, ("mean", "median", "sum"))


# medians per time step on the path that large inputs take
on_view("agg_5_ranked", "grid", lambda d: rounded(stats.spatial_series(d, "chl", "median"), ["chl"]),
        "SELECT time, round(quantile_cont(chl, 0.5), 6) AS chl FROM grid GROUP BY time")
on_view("agg_6", "grid", lambda d: stats.coverage(d, ["lat"]),
        "SELECT lat, min(time) AS first, max(time) AS last, count(DISTINCT time) AS steps FROM grid GROUP BY lat")
on_view("agg_7", "samples", lambda d: stats.level_counts(labels.score_rules(d)), """
SELECT level, CAST(sum(k) AS BIGINT) AS n FROM (SELECT level, 1 AS k FROM scored UNION ALL SELECT unnest(['LOW', 'MEDIUM', 'HIGH']), 0) GROUP BY level""")
on_view("agg_8", "samples", lambda d: rounded(stats.summary(labels.score_rules(d)), ["average_confidence"]), """
SELECT count(*) AS total_samples, count(*) FILTER (level = 'LOW') AS n_low, count(*) FILTER (level = 'MEDIUM') AS n_medium,
  count(*) FILTER (level = 'HIGH') AS n_high, count(*) FILTER (level = 'CRITICAL') AS n_critical, round(avg(confidence), 6) AS average_confidence,
  count(*) FILTER (level IN ('HIGH', 'CRITICAL')) AS high_risk_count, count(*) FILTER (level IN ('LOW', 'MEDIUM')) AS low_risk_count,
  CASE WHEN count(*) FILTER (level IN ('HIGH', 'CRITICAL')) > 0.3 * count(*) THEN 'CRITICAL - Immediate action required'
   WHEN count(*) FILTER (level IN ('HIGH', 'CRITICAL')) > 0.1 * count(*) THEN 'HIGH - Monitor closely'
   ELSE 'NORMAL - Regular monitoring sufficient' END AS risk_assessment FROM scored""")
on_view("agg_9", "samples", lambda d: rounded(stats.batch_stats(labels.score_rules(d.withColumn(
    "chl", F.when(F.col("id") % 9 > 0, F.col("chl"))))), ["success_rate"]), """
SELECT count(*) AS total, count(*) FILTER (id % 9 > 0) AS successful, count(*) FILTER (id % 9 > 0 AND level = 'HIGH') AS high_risk,
  round(count(*) FILTER (id % 9 > 0) / count(*), 6) AS success_rate FROM scored""")
DESCRIBED = ("chl", "pp", "kd490")
on_view("agg_10", "samples", lambda d: rounded(stats.describe_exact(d, DESCRIBED), ("mean", "std", "min", "p25", "p50", "p75", "max")),
        " UNION ALL ".join(f"""SELECT '{v}' AS var, count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
  round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS max FROM samples"""
                           for v in DESCRIBED))
on_view("agg_11", "grid", lambda d: rounded(stats.correlation(d, "chl", "sst"), ["r"]), "SELECT round(corr(chl, sst), 6) AS r FROM grid")
on_view("agg_12", "grid", lambda d: rounded(stats.corr_matrix(d, GRID_VARS), ["r"]), " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM grid" for a in GRID_VARS for b in GRID_VARS))
on_view("agg_13", "grid", lambda d: rounded(stats.histogram(d, "sst", 20), ("left_edge", "right_edge")), """
WITH m AS (SELECT min(sst) AS lo, (max(sst) - min(sst)) / 20 AS w FROM grid),
c AS (SELECT least(CAST(floor((sst - lo) / w) AS BIGINT), 19) AS bin, count(*) AS n FROM grid, m WHERE sst IS NOT NULL GROUP BY 1)
SELECT b.bin, round(lo + w * b.bin, 6) AS left_edge, round(lo + w * (b.bin + 1), 6) AS right_edge, COALESCE(n, 0) AS n
FROM range(20) b(bin) CROSS JOIN m LEFT JOIN c ON c.bin = b.bin""")
BOX = ("mean", "q1", "median", "q3", "whisker_low", "whisker_high")
on_view("agg_14", "samples", lambda d: rounded(stats.box_stats(labels.score_rules(d), "pp", ["level"]), BOX), """
WITH q AS (SELECT level, quantile_cont(pp, 0.25) AS q1, quantile_cont(pp, 0.5) AS med, quantile_cont(pp, 0.75) AS q3 FROM scored GROUP BY level),
j AS (SELECT s.level, s.pp, q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM scored s JOIN q ON s.level = q.level)
SELECT level, count(pp) AS n, round(avg(pp), 6) AS mean, round(min(q1), 6) AS q1, round(min(med), 6) AS median, round(min(q3), 6) AS q3,
  round(least(min(pp) FILTER (pp >= lo), min(q1)), 6) AS whisker_low, round(greatest(max(pp) FILTER (pp <= hi), max(q3)), 6) AS whisker_high,
  count(*) FILTER (pp < lo OR pp > hi) AS outliers FROM j GROUP BY level""")


@query("agg_15", """
SELECT floor(lat / 2) * 2 AS lat, floor(lon / 2) * 2 AS lon, count(*) AS n, round(avg(chl), 6) AS chl,
  (SELECT round(avg(lat), 6) FROM grid) AS centre_lat, (SELECT round(avg(lon), 6) FROM grid) AS centre_lon
FROM grid WHERE chl IS NOT NULL GROUP BY 1, 2""")
def agg_15(spark: SparkSession, folder: str) -> DataFrame:
    grid = view(spark, folder, "grid")
    centre = stats.map_centre(grid).select(F.struct("lat", "lon").alias("c")).scalar()
    return rounded(stats.heat_cells(grid, "chl", 2.0).withColumns({"centre_lat": centre["lat"], "centre_lon": centre["lon"]}),
                   ("chl", "centre_lat", "centre_lon"))


on_view("agg_16", "grid", lambda d: rounded(stats.hotspots(labels.label_by_threshold(d, "map")), ["mean_chl"]),
        "SELECT count(*) AS points, count(*) FILTER (chl > 3 AND chl <= 100) AS high_points, round(avg(chl), 6) AS mean_chl FROM grid")
on_view("agg_17", "samples", lambda d: rounded(stats.class_distribution(labels.score_rules(d), "level"), ["pct"]),
        "SELECT level, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM scored WHERE level IS NOT NULL GROUP BY level")
on_view("agg_18", "samples", lambda d: rounded(stats.monthly_levels(labels.score_rules(d)), ("low_pct", "medium_pct", "high_pct")), """
SELECT CAST(month(ts) AS INT) AS month, count(*) AS n, round(100.0 * count(*) FILTER (level = 'LOW') / count(*), 6) AS low_pct,
  round(100.0 * count(*) FILTER (level = 'MEDIUM') / count(*), 6) AS medium_pct, round(100.0 * count(*) FILTER (level = 'HIGH') / count(*), 6) AS high_pct
FROM scored WHERE level IS NOT NULL GROUP BY 1""")


def _catalog(file: str, source: str, v: str) -> str:
    return (f"SELECT '{file}' AS file, '{v}' AS var, 'double' AS dtype, count(*) AS n_rows, count(*) - count({v}) AS null_count, "
            f"round(100.0 * (count(*) - count({v})) / count(*), 6) AS null_pct FROM {source}")


@query("agg_19", " UNION ALL ".join([_catalog("a", "grid", v) for v in GRID_VARS] + [_catalog("b", "grid_b", v) for v in ("cdm", "bbp")]))
def agg_19(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.catalog({"a": view(spark, folder, "grid"), "b": view(spark, folder, "grid_b")})
    return rounded(found.drop("attrs"), ["null_pct"])
