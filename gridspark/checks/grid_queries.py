"""Queries of sources, sinks, filters, joins, set operations and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.checks.fixtures import GRID_VARS, view
from gridspark.checks.registry import on_view, query, rounded
from gridspark.functions.frames import COORDS, shared_folder
from gridspark.operators import align, derive, filters, labels, missing, sampling, scoring, text
from gridspark.sources import readers, sinks

GRID = ", ".join(("time", "lat", "lon", *GRID_VARS))


# ---------------------------------------------------------------- sources

@query("src_1", """
SELECT time, lat, lon, chl, pp FROM grid
WHERE time BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND lat BETWEEN 20 AND 25 AND lon BETWEEN -95 AND -90""")
def src_1(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "src_1")
    raw = view(spark, folder, "grid").withColumnsRenamed({"lat": "latitude", "lon": "Longitude", "chl": "CHL", "pp": "PP"})
    raw.write.parquet(path)
    return readers.read_grid(spark, path, ["chl", "pp", "oxygen"], ("1994-01-01", "1996-12-31"),
                             {"latitude": (20, 25), "lon": (-90, -95)})


@query("src_2", f"""
SELECT {GRID}, CAST(NULL AS DOUBLE) AS cdm, CAST(NULL AS DOUBLE) AS bbp FROM grid
UNION ALL SELECT time, lat, lon, {", ".join(f"NULL AS {v}" for v in GRID_VARS)}, cdm, bbp FROM grid_b""")
def src_2(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "src_2")
    view(spark, folder, "grid").write.parquet(f"{path}/a")
    view(spark, folder, "grid_b").write.parquet(f"{path}/b")
    out = readers.read_grids(spark, path)
    return out.select("time", "lat", "lon", *GRID_VARS, "cdm", "bbp")


@query("src_3", "SELECT chl, pp, kd490, diato FROM samples")
def src_3(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "src_3")
    rows = view(spark, folder, "samples").select(
        F.col("id").alias("ID"), F.col("kd490").alias("KD490"), F.col("chl").alias("CHL"),
        F.col("pp").alias("PP"), F.col("diato").alias("DIATO"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_samples(spark, path, "txt").select("chl", "pp", "kd490", "diato")


def _number(key: str) -> str:
    return f"TRY_CAST(regexp_extract(upper(line), '{key}=([^ ]+)', 1) AS DOUBLE) AS {key.lower()}"


on_view("src_4", "kv", lambda d: d.withColumn("m", text.parse_kv("line")).select(
    "id", *[F.col("m").getItem(k).alias(k.lower()) for k in ("CHL", "PP", "KD490")],
    F.size("m").cast("long").alias("n_keys")), f"""
SELECT *, CAST((chl IS NOT NULL)::INT + (pp IS NOT NULL)::INT + (kd490 IS NOT NULL)::INT AS BIGINT) AS n_keys
FROM (SELECT id, {_number("CHL")}, {_number("PP")}, {_number("KD490")} FROM kv)""")

on_view("src_5", "lists", lambda d: d.select(
    "id", F.posexplode(text.parse_values("line")).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), """
SELECT id, CAST(pos AS BIGINT) AS pos, TRY_CAST(trim(parts[pos + 1]) AS DOUBLE) AS value
FROM (SELECT id, parts, unnest(range(len(parts))) AS pos FROM (SELECT id, string_split(line, ',') AS parts FROM lists))""")


@query("src_6")
def src_6(spark: SparkSession, folder: str) -> DataFrame:
    return readers.file_inventory(spark, folder, "*.parquet").select("filename", "size_bytes", "size_mb", "type", "md5")


@query("src_6_digests", """
WITH texts AS (SELECT s_name || '|' || CAST(s_suppkey AS VARCHAR) || chr(10) AS t FROM supplier)
SELECT CAST(strlen(t) AS BIGINT) AS size_bytes, 'txt' AS type, md5(t) AS md5 FROM texts""")
def src_6_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One file per supplier, listed with the digests of what was written."""
    path = shared_folder(spark, "src_6")
    lines = spark.read.parquet(f"{folder}/supplier.parquet").select(F.concat_ws("|", "s_name", "s_suppkey"))
    sinks.write_line_files(lines, path)
    return readers.file_inventory(spark, path, "*.txt").select("size_bytes", "type", "md5")


# ---------------------------------------------------------------- sinks

@query("snk_1", f"SELECT {GRID}, CAST(EXTRACT(YEAR FROM time) AS INT) AS year FROM grid")
def snk_1(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "snk_1")
    sinks.write_grid(view(spark, folder, "grid"), path)
    return spark.read.parquet(path)


SPLIT_SQL = """
SELECT time, lat, lon, chl, CASE WHEN rn <= floor(n * CAST(0.2 AS DOUBLE)) THEN 'test'
  WHEN rn <= floor(n * CAST(0.2 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(time AS VARCHAR), CAST(lat AS VARCHAR),
  CAST(lon AS VARCHAR)))) AS rn, count(*) OVER () AS n FROM grid)"""


@query("snk_2", SPLIT_SQL)
def snk_2(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "snk_2")
    rows = view(spark, folder, "grid").select(*COORDS, "chl")
    sinks.write_splits(sampling.split(rows, COORDS), path, ["lat", "lon"], "chl")
    data, _, target = sinks.read_splits(spark, path)
    return data.select(*COORDS, target, "split")


def _stats(v: str) -> str:
    return (f"SELECT '{v}' AS feature, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, "
            f"round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(quantile_cont({v}, 0.5), 6) AS median FROM grid")


@query("snk_3", " UNION ALL ".join(_stats(v) for v in GRID_VARS))
def snk_3(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "snk_3")
    sinks.write_stats(sinks.feature_stats(view(spark, folder, "grid"), GRID_VARS), path)
    return rounded(sinks.read_stats(spark, path), ("mean", "std", "min", "max", "median"))


FORECAST_SQL = """
WITH last AS (SELECT cell, v FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY time DESC) AS rn FROM series) WHERE rn = 1),
days AS (SELECT cell, v, CAST(DATE '2024-06-01' + CAST(i AS INT) AS DATE) AS date FROM last, range(7) t(i)),
moved AS (SELECT cell, date, v * (1 + 0.1 * sin(2 * pi() * dayofyear(date) / CAST(365 AS DOUBLE))) AS chl FROM days),
lv AS (SELECT *, CASE WHEN chl < 1 THEN 'LOW' WHEN chl < 3 THEN 'MEDIUM' WHEN chl IS NOT NULL THEN 'HIGH' END AS predicted_level FROM moved)
SELECT cell, date, predicted_level,
  CAST(CASE predicted_level WHEN 'LOW' THEN 0.85 WHEN 'MEDIUM' THEN 0.75 WHEN 'HIGH' THEN 0.80 END AS DOUBLE) AS confidence,
  CASE WHEN predicted_level IS NULL THEN 'UNKNOWN' ELSE concat(predicted_level, '_RISK') END AS risk_level,
  round(chl, 6) AS chl FROM lv"""


def _forecast(spark: SparkSession, folder: str) -> DataFrame:
    history = view(spark, folder, "series").withColumnRenamed("v", "chl")
    return scoring.forecast(history, "2024-06-01", 7, cell=("cell",)).withColumnRenamed("series_cell", "cell")


@query("fc_1", FORECAST_SQL)
def fc_1(spark: SparkSession, folder: str) -> DataFrame:
    return _forecast(spark, folder).select("cell", "date", "predicted_level", "confidence", "risk_level",
                                           F.round(F.col("features")["chl"], 6).alias("chl"))


@query("snk_5", FORECAST_SQL)
def snk_5(spark: SparkSession, folder: str) -> DataFrame:
    path = sinks.write_forecast(_forecast(spark, folder), shared_folder(spark, "snk_5"), "20240601_000000")
    back = spark.read.option("header", True).option("escape", '"').schema(
        "cell string, date date, predicted_level string, confidence double, risk_level string, features string").csv(path)
    chl = F.from_json("features", "map<string,double>")["chl"]
    return back.withColumn("chl", F.round(chl, 6)).drop("features")


@query("snk_6", "SELECT id, chl, level, confidence FROM scored WHERE level IN ('HIGH', 'MEDIUM') AND confidence >= 0.8")
def snk_6(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "snk_6")
    chosen = filters.filter_history(labels.score_rules(view(spark, folder, "samples")), ["HIGH", "MEDIUM"], 0.8)
    sinks.export_history(chosen, path, ["id", "chl", "level", "confidence"])
    return spark.read.option("header", True).schema("id long, chl double, level string, confidence double").csv(path)


# ---------------------------------------------------------------- filters

on_view("flt_1", "grid", lambda d: filters.filter_time(d, "1993-03-01", "1995-05-01"),
        f"SELECT {GRID} FROM grid WHERE time BETWEEN DATE '1993-03-01' AND DATE '1995-05-01'")
on_view("flt_2", "grid", lambda d: filters.filter_bbox(
    d.withColumnsRenamed({"lat": "latitude", "lon": "longitude"}), {"latitude": (20.0, 24.0), "lon": (-96.0, -92.0)}),
    f"SELECT {GRID} FROM grid WHERE lat BETWEEN 20 AND 24 AND lon BETWEEN -96 AND -92")
on_view("flt_3", "grid", lambda d: filters.select_vars(d, ["CHL", "sst", "nothing"]),
        "SELECT time, lat, lon, chl, sst FROM grid")
on_view("flt_4", "grid", lambda d: filters.canonical_coords(
    d.withColumnsRenamed({"lat": "Latitude", "lon": "longitude"})), f"SELECT {GRID} FROM grid")
on_view("flt_5", "grid", lambda d: filters.drop_missing(d.withColumn("empty", F.lit(None).cast("double"))),
        f"SELECT {GRID} FROM grid WHERE chl IS NOT NULL AND kd490 IS NOT NULL")
on_view("flt_6", "grid", lambda d: filters.complete_cases(d, "pp", ["chl", "sst"]),
        f"SELECT {GRID} FROM grid WHERE chl IS NOT NULL")
on_view("flt_7", "grid", lambda d: filters.select_xy(d, None, ["oxygen"]),
        f"SELECT {', '.join(v for v in GRID_VARS if v != 'kd490')}, kd490 FROM grid")
on_view("flt_8", "grid", lambda d: d.withColumns({"flags": F.lit(1), "CHL_uncertainty": F.col("chl") * 0.1}).select(
    *COORDS, *filters.feature_columns(d.withColumns({"flags": F.lit(1), "CHL_uncertainty": F.col("chl")}))),
    f"SELECT {GRID} FROM grid")
on_view("flt_9", "samples", lambda d: filters.filter_history(labels.score_rules(d), ["LOW", "HIGH"], 0.8).select(
    "id", "level", "confidence"),
    "SELECT id, level, confidence FROM scored WHERE level IN ('LOW', 'HIGH') AND confidence >= 0.8")
on_view("flt_10", "samples", lambda d: filters.validate_samples(d.withColumn("pp", F.col("pp") - 100)).select(
    "id", F.size("reasons").cast("long").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons")), """
SELECT id, CAST((chl > 50)::INT + COALESCE((pp - 100 < 0)::INT, 0) AS BIGINT) AS n_reasons,
  concat_ws('; ', CASE WHEN chl > 50 THEN 'chl above 50' END, CASE WHEN pp - 100 < 0 THEN 'pp below 0' END) AS reasons FROM samples""")
on_view("flt_11", "samples", lambda d: filters.blank_zeros(d).select("id", "chl", "pp", "kd490", "diato"), """
SELECT id, chl, CASE WHEN pp > 0 THEN pp END AS pp, CASE WHEN kd490 > 0 THEN kd490 END AS kd490,
  CASE WHEN diato > 0 THEN diato END AS diato FROM samples""")
on_view("flt_12", "grid", lambda d: filters.extremes(d, "chl").select(*COORDS, "chl"),
        "SELECT time, lat, lon, chl FROM grid WHERE chl > (SELECT quantile_cont(chl, 0.95) FROM grid)")
on_view("flt_13", "series", lambda d: filters.every_nth(d, 7, cell=("cell",)), """
SELECT cell, time, v FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY time) AS rn FROM series) WHERE (rn - 1) % 7 = 0""")

on_view("ord_1", "grid", lambda d: filters.sort_time(d), f"SELECT {GRID} FROM grid ORDER BY time, lat, lon")
on_view("ord_2", "samples", lambda d: filters.page(d, 3, 25).select("id", "chl", "ts"),
        "SELECT id, chl, ts FROM samples ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 50")
on_view("ord_3", "samples", lambda d: filters.top_k(d, "pp", 10, "id").select("id", "pp"),
        "SELECT id, pp FROM samples ORDER BY pp DESC NULLS LAST, id LIMIT 10")

on_view("tx_1", "urls", lambda d: d.select("id", text.file_id("url").alias("file_id"), text.file_name("url").alias("file_name")), """
SELECT id, COALESCE(NULLIF(regexp_extract(url, '/file/d/([a-zA-Z0-9_-]+)', 1), ''), NULLIF(regexp_extract(url, 'id=([a-zA-Z0-9_-]+)', 1), ''),
    NULLIF(regexp_extract(url, '/d/([a-zA-Z0-9_-]+)/', 1), ''), NULLIF(regexp_extract(url, '/d/([a-zA-Z0-9_-]+)$', 1), '')) AS file_id,
  COALESCE(NULLIF(regexp_extract(url, '[?&]name=([^&#]+)', 1), ''), CASE WHEN contains(leaf, '.') THEN leaf END) AS file_name
FROM (SELECT *, list_extract(string_split(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/view$', ''), '/'), -1) AS leaf FROM urls)""")
on_view("tx_2", "listing", lambda d: d.where(text.name_contains(F.col("var"), "Chl")).groupBy("file").agg(
    F.count("*").alias("n")), "SELECT file, count(*) AS n FROM listing WHERE contains(upper(var), 'CHL') GROUP BY file")


# ---------------------------------------------------------------- joins and alignment

@query("jn_1", f"""
SELECT COALESCE(a.time, b.time) AS time, COALESCE(a.lat, b.lat) AS lat, COALESCE(a.lon, b.lon) AS lon,
  {", ".join(f"a.{v}" for v in GRID_VARS)}, b.cdm, b.bbp
FROM (SELECT * REPLACE (lat + 2 AS lat) FROM grid) a FULL JOIN grid_b b ON a.time = b.time AND a.lat = b.lat AND a.lon = b.lon""")
def jn_1(spark: SparkSession, folder: str) -> DataFrame:
    a = view(spark, folder, "grid").withColumn("lat", F.col("lat") + 2)
    b = view(spark, folder, "grid_b").withColumn("chl", F.lit(-1.0))
    return align.merge_grids([a, b])


@query("jn_2", """
WITH ga AS (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS ti, dense_rank() OVER (ORDER BY lat) - 1 AS yi, dense_rank() OVER (ORDER BY lon) - 1 AS xi FROM grid),
gb AS (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS ti, dense_rank() OVER (ORDER BY lat) - 1 AS yi, dense_rank() OVER (ORDER BY lon) - 1 AS xi FROM grid_b)
SELECT p.time_idx, p.lat_idx, p.lon_idx, ga.chl, ga.sst, gb.cdm, gb.bbp FROM points p
LEFT JOIN ga ON p.time_idx = ga.ti AND p.lat_idx = ga.yi AND p.lon_idx = ga.xi
LEFT JOIN gb ON p.time_idx = gb.ti AND p.lat_idx = gb.yi AND p.lon_idx = gb.xi""")
def jn_2(spark: SparkSession, folder: str) -> DataFrame:
    a = view(spark, folder, "grid").select(*COORDS, "chl", "sst")
    return align.lookup_by_position(view(spark, folder, "points"), [a, view(spark, folder, "grid_b")])


on_view("jn_3", "grid", lambda d: align.densify(d), f"SELECT {GRID} FROM dense")
def _nearest(source: str, cols: Sequence[str], digits: int | None = None) -> str:
    """Every variable of ``source`` with its gaps filled from the nearest cell of the slice."""
    out, tables, joins = [], [], []
    for c in cols:
        tables.append(f"""p_{c} AS (SELECT m.time, m.lat, m.lon, v.{c}, row_number() OVER (PARTITION BY m.time, m.lat, m.lon
    ORDER BY (m.lat - v.lat)**2 + (m.lon - v.lon)**2, v.lat, v.lon) AS rn
  FROM {source} m JOIN (SELECT time FROM {source} GROUP BY time HAVING count({c}) >= 10) ok ON m.time = ok.time
  JOIN {source} v ON v.time = m.time AND v.{c} IS NOT NULL WHERE m.{c} IS NULL)""")
        joins.append(f"LEFT JOIN p_{c} ON p_{c}.time = d.time AND p_{c}.lat = d.lat AND p_{c}.lon = d.lon AND p_{c}.rn = 1")
        value = f"COALESCE(d.{c}, p_{c}.{c})"
        out.append(f"{value if digits is None else f'round({value}, {digits})'} AS {c}")
    return f"WITH {', '.join(tables)} SELECT d.time, d.lat, d.lon, {', '.join(out)} FROM {source} d {' '.join(joins)}"


on_view("jn_4", "grid", lambda d: align.fill_spatial_nearest(align.densify(d), GRID_VARS).select(*COORDS, *GRID_VARS),
        _nearest("dense", GRID_VARS))
on_view("jn_5", "grid", lambda d: align.series_at(d, 22.6, -93.5).select(*COORDS, "chl", "sst"), """
SELECT time, lat, lon, chl, sst FROM grid
WHERE lat = (SELECT lat FROM grid ORDER BY abs(lat - 22.6), lat LIMIT 1) AND lon = (SELECT lon FROM grid ORDER BY abs(lon + 93.5), lon LIMIT 1)""")


@query("jn_6", """
SELECT e.file, e.var FROM expected e WHERE NOT EXISTS (SELECT 1 FROM actual a WHERE a.file = e.file
  AND (contains(upper(a.var), upper(e.var)) OR contains(upper(e.var), upper(a.var))))""")
def jn_6(spark: SparkSession, folder: str) -> DataFrame:
    return align.missing_variables(view(spark, folder, "expected"), view(spark, folder, "actual"))


on_view("jn_7", "grid", lambda d: d.select(*COORDS, derive.day_of_year().alias("day_of_year"),
                                           derive.abs_latitude().alias("abs_latitude")),
        "SELECT time, lat, lon, CAST(dayofyear(time) AS INT) AS day_of_year, abs(lat) AS abs_latitude FROM grid")
on_view("jn_8", "series", lambda d: align.with_days(d.select("cell", "time"), 5, "2024-02-27"), """
SELECT cell, time, CAST(i AS INT) AS day, CAST(DATE '2024-02-27' + CAST(i AS INT) AS DATE) AS date FROM series, range(5) t(i)""")


@query("jn_9", f"""
WITH f AS ({FORECAST_SQL.strip().replace("DATE '2024-06-01'", "DATE '2024-01-10'")}),
a AS (SELECT cell, time AS date, v AS actual FROM series)
SELECT f.cell, f.date, f.chl, a.actual FROM f LEFT JOIN a ON f.cell = a.cell AND f.date = a.date""")
def jn_9(spark: SparkSession, folder: str) -> DataFrame:
    series = view(spark, folder, "series")
    ahead = scoring.forecast(series.withColumnRenamed("v", "chl"), "2024-01-10", 7, cell=("cell",)).select(
        F.col("series_cell").alias("cell"), "date", F.round(F.col("features")["chl"], 6).alias("chl"))
    actual = series.select("cell", F.col("time").alias("date"), F.col("v").alias("actual"))
    return align.forecast_vs_actual(ahead, actual, ("cell", "date"))


@query("jn_10", "SELECT id, chl FROM samples WHERE id % 7 <> 0")
def jn_10(spark: SparkSession, folder: str) -> DataFrame:
    records = view(spark, folder, "samples").select("id", "chl")
    return align.drop_records(records, records.where("id % 7 = 0"))


# ---------------------------------------------------------------- set operations

@query("set_1", """
SELECT time, lat, lon, chl, CAST(NULL AS DOUBLE) AS bbp FROM grid
UNION ALL SELECT time, lat, lon, NULL, bbp FROM grid_b""")
def set_1(spark: SparkSession, folder: str) -> DataFrame:
    a = view(spark, folder, "grid").select(*COORDS, "chl")
    return align.concat_time([a, view(spark, folder, "grid_b").select(*COORDS, "bbp")])


on_view("set_2", "actual", lambda d: align.common_variables(d), """
SELECT var, count(DISTINCT file) AS n_files FROM actual GROUP BY var
HAVING count(DISTINCT file) = (SELECT count(DISTINCT file) FROM actual)""")


@query("set_3", "SELECT file, upper(replace(var, '_mean', '')) AS var FROM expected EXCEPT ALL SELECT file, var FROM actual")
def set_3(spark: SparkSession, folder: str) -> DataFrame:
    want = view(spark, folder, "expected").withColumn("var", F.upper(F.replace("var", F.lit("_mean"), F.lit(""))))
    return align.requested_minus_available(want, view(spark, folder, "actual"))


on_view("set_4", "listing", lambda d: filters.distinct_ordered(d, "var", "pos"), """
SELECT file, pos, var FROM (SELECT *, row_number() OVER (PARTITION BY var ORDER BY pos) AS rn FROM listing) WHERE rn = 1""")


def _compatible(d: str) -> str:
    return f"""SELECT '{d}' AS dim, count(*) FILTER (x.v IS NULL OR y.v IS NULL) AS unmatched,
  count(*) FILTER (abs(x.v - y.v) > 1e-8 + 1e-5 * abs(y.v)) AS different
FROM (SELECT {d} AS v, row_number() OVER (ORDER BY {d}) AS i FROM (SELECT DISTINCT {d} FROM grid)) x
FULL JOIN (SELECT {d} AS v, row_number() OVER (ORDER BY {d}) AS i FROM (SELECT DISTINCT {d} FROM grid_b)) y ON x.i = y.i"""


@query("set_5", f"SELECT *, unmatched = 0 AND different = 0 AS compatible FROM ({_compatible('lat')} UNION ALL {_compatible('lon')})")
def set_5(spark: SparkSession, folder: str) -> DataFrame:
    return align.check_compatible(view(spark, folder, "grid"), view(spark, folder, "grid_b"))


# ---------------------------------------------------------------- missing values

def _interpolated(v: str, source: str, keys: str) -> str:
    """Linear in time, at most three steps after the last valid value."""
    known = f"CASE WHEN {v} IS NOT NULL THEN time END"
    w = f"(PARTITION BY {keys} ORDER BY time"
    return f"""SELECT *, CASE WHEN {v} IS NOT NULL THEN {v} WHEN gap <= 3 THEN
   pv + (nv - pv) * CAST(date_diff('day', pt, time) AS DOUBLE) / CAST(date_diff('day', pt, nt) AS DOUBLE) END AS {v}_filled FROM (
  SELECT *, last_value({v} IGNORE NULLS) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
    last_value({known} IGNORE NULLS) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
    first_value({v} IGNORE NULLS) OVER {w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv,
    first_value({known} IGNORE NULLS) OVER {w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt,
    rn - max(CASE WHEN {v} IS NOT NULL THEN rn END) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY time) AS rn FROM {source}))"""


on_view("mv_1", "grid", lambda d: rounded(missing.interpolate_time(align.densify(d), ["kd490", "chl"]), ["chl", "kd490"]).select(
    *COORDS, "chl", "kd490"), f"""
WITH a AS ({_interpolated("chl", "dense", "lat, lon")}), b AS ({_interpolated("kd490", "dense", "lat, lon")})
SELECT a.time, a.lat, a.lon, round(a.chl_filled, 6) AS chl, round(b.kd490_filled, 6) AS kd490
FROM a JOIN b ON a.time = b.time AND a.lat = b.lat AND a.lon = b.lon""")

# the same on the few long series of events, cut into blocks
on_view("mv_1_series", "series", lambda d: rounded(
    missing.interpolate_time(d, ["v"], cell=("cell",), long_series=True), ["v"]),
    f"SELECT cell, time, round(v_filled, 6) AS v FROM ({_interpolated('v', 'series', 'cell')})")

on_view("mv_2", "grid", lambda d: rounded(missing.fill_missing(align.densify(d), GRID_VARS).select(*COORDS, *GRID_VARS), GRID_VARS, 8),
        "WITH " + ", ".join(f"i_{c} AS ({_interpolated(c, 'dense', 'lat, lon')})" for c in GRID_VARS)
        + ", filled AS (SELECT d.time, d.lat, d.lon, " + ", ".join(f"i_{c}.{c}_filled AS {c}" for c in GRID_VARS) + " FROM dense d "
        + " ".join(f"JOIN i_{c} ON i_{c}.time = d.time AND i_{c}.lat = d.lat AND i_{c}.lon = d.lon" for c in GRID_VARS)
        + "), " + _nearest("filled", GRID_VARS, 8).removeprefix("WITH "))

W = "(PARTITION BY lat, lon ORDER BY time ROWS BETWEEN"
on_view("mv_3", "grid", lambda d: missing.ffill(align.densify(d), ["chl"]).select(*COORDS, "chl"),
        f"SELECT time, lat, lon, last_value(chl IGNORE NULLS) OVER {W} 3 PRECEDING AND CURRENT ROW) AS chl FROM dense")
on_view("mv_4", "grid", lambda d: missing.bfill(align.densify(d), ["chl"]).select(*COORDS, "chl"),
        f"SELECT time, lat, lon, first_value(chl IGNORE NULLS) OVER {W} CURRENT ROW AND 3 FOLLOWING) AS chl FROM dense")
on_view("mv_5", "grid", lambda d: rounded(missing.fill_mean(d, ["chl", "kd490"]), ["chl", "kd490"]).select(
    *COORDS, "chl", "kd490"), """
SELECT time, lat, lon, round(COALESCE(chl, (SELECT avg(chl) FROM grid)), 6) AS chl,
  round(COALESCE(kd490, (SELECT avg(kd490) FROM grid)), 6) AS kd490 FROM grid""")
on_view("mv_6", "grid", lambda d: rounded(missing.fill_median(d, ["chl", "kd490"]), ["chl", "kd490"]).select(
    *COORDS, "chl", "kd490"), """
SELECT time, lat, lon, round(COALESCE(chl, (SELECT quantile_cont(chl, 0.5) FROM grid)), 6) AS chl,
  round(COALESCE(kd490, (SELECT quantile_cont(kd490, 0.5) FROM grid)), 6) AS kd490 FROM grid""")
on_view("mv_7", "grid", lambda d: rounded(missing.fill_slice_mean(d, ["chl"]), ["chl"]).select(*COORDS, "chl"),
        "SELECT time, lat, lon, round(COALESCE(chl, avg(chl) OVER (PARTITION BY time)), 6) AS chl FROM grid")


@query("mv_8", """
WITH j AS (SELECT g.time, g.lat, g.lon, g.chl, CASE WHEN b.cdm > 0.06 THEN b.cdm END AS cdm FROM grid g
  LEFT JOIN grid_b b ON g.time = b.time AND g.lat = b.lat AND g.lon = b.lon)
SELECT time, lat, lon, round(COALESCE(chl, (SELECT quantile_cont(chl, 0.5) FROM j)), 6) AS chl FROM j""")
def mv_8(spark: SparkSession, folder: str) -> DataFrame:
    a = view(spark, folder, "grid").select(*COORDS, "chl")
    both = align.lookup_by_coords(a, [view(spark, folder, "grid_b").select(*COORDS, "cdm")])
    sparse = both.withColumn("cdm", F.when(F.col("cdm") > 0.06, F.col("cdm")))
    return rounded(missing.keep_and_fill(sparse, ["chl", "cdm"]), ["chl"])


on_view("mv_9", "samples", lambda d: missing.fill_zero(d, ["chl", "pp", "kd490", "bbp"]).select("id", "chl", "pp", "kd490", "bbp"), """
SELECT id, COALESCE(chl, 0.0) AS chl, COALESCE(pp, 0.0) AS pp, COALESCE(kd490, 0.0) AS kd490, CAST(0 AS DOUBLE) AS bbp FROM samples""")

WANTED = ("CHL", "CHL_uncertainty", "PP", "PP_uncertainty", "KD490", "DIATO", "DIATO_uncertainty", "GREEN", "CDM", "BBP", "flags")
on_view("mv_10", "samples", lambda d: rounded(missing.impute_features(
    d.withColumnsRenamed({"chl": "CHL", "pp": "PP", "kd490": "KD490", "diato": "DIATO"}), WANTED, {"kd490": 0.33}, "cli", "CHL"),
    WANTED).select("id", *[F.col(c).alias(c.lower()) for c in WANTED]), """
SELECT id, round(chl, 6) AS chl, round(chl * 0.1, 6) AS chl_uncertainty, round(COALESCE(pp, chl * 100), 6) AS pp,
  round(chl * 100, 6) AS pp_uncertainty, round(COALESCE(kd490, CAST(0.33 AS DOUBLE)), 6) AS kd490,
  round(COALESCE(diato, chl * 0.01), 6) AS diato, round(chl * 0.005, 6) AS diato_uncertainty, round(chl * 0.01, 6) AS green,
  round(0.01 + chl * 0.002, 6) AS cdm, round(0.001 + chl * 0.0003, 6) AS bbp, CAST(0 AS DOUBLE) AS flags FROM samples""")


def _pairs():
    return F.array(F.struct(F.lit("CHL_uncertainty").alias("k"), (F.col("chl") * 0.1).alias("v")),
                   F.struct(F.lit("pp").alias("k"), F.col("pp").alias("v")),
                   F.struct(F.lit("chl").alias("k"), F.when(F.col("id") % 3 > 0, F.col("chl")).alias("v")))


on_view("mv_11", "samples", lambda d: rounded(d.select(
    "id", missing.resolve_chl(_pairs()).alias("cli"), missing.resolve_chl(_pairs(), "api").alias("api")), ["cli", "api"]), """
SELECT id, round(CASE WHEN id % 3 > 0 THEN chl ELSE chl * 0.1 END, 6) AS cli, round(chl * 0.1, 6) AS api FROM samples""")
