"""Profiles, summaries, validation rules and report aggregates.

Everything about several variables is computed in one aggregate and turned to rows
afterwards, so the data is read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS, bind, numeric_columns, one_of, one_row, present
from gridspark.functions.quantiles import percentile_row, percentiles
from gridspark.operators.outliers import detect_outliers
from gridspark.operators.temporal import axis_regularity

LEVELS = ("LOW", "MEDIUM", "HIGH")
CHECKED = ("chl", "kd490", "zsd", "pp")

AGGREGATES = ("mean", "median", "sum", "min", "max")


def _lines(df: DataFrame, lines: Sequence[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*lines)))


def profile_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per variable: missing count and share in %, type, and whether a fill value is declared."""
    cols = list(cols or numeric_columns(df))
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    kinds = {f.name: f for f in df.schema.fields}

    def line(c: str) -> Column:
        gone = F.col("_n") - F.col(c)
        meta = kinds[c].metadata
        return F.struct(F.lit(c).alias("var"), gone.alias("null_count"),
                        (F.try_divide(gone, F.col("_n")) * 100).alias("null_pct"),
                        F.lit(kinds[c].dataType.simpleString()).alias("dtype"),
                        F.lit("_FillValue" in meta or "missing_value" in meta).alias("has_fill_value"))

    return _lines(counts, [line(c) for c in cols])


def profile_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per variable: mean, population deviation, min, max, median, missing flag, declared range."""
    cols = list(cols or numeric_columns(df))
    wide = df.agg(F.count("*").alias("_n"), *[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                 F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
        for c in cols])
    wide, med = bind(wide, percentile_row(df, cols, [0.5]))
    meta = {f.name: f.metadata for f in df.schema.fields}

    def line(c: str) -> Column:
        span = meta[c].get("valid_range") or meta[c].get("actual_range") or [None, None]
        low, high = (F.lit(x).cast("double") for x in span)
        return F.struct(F.lit(c).alias("var"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"),
                        F.col(f"{c}.std").alias("std"), F.col(f"{c}.min").alias("min"),
                        F.col(f"{c}.max").alias("max"), med[c][0].alias("median"),
                        (F.col(f"{c}.n") < F.col("_n")).alias("has_null"),
                        low.alias("valid_min"), high.alias("valid_max"))

    return _lines(wide, [line(c) for c in cols])


def _finding(severity: str, rule: str, var: Column, value: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
            var.alias("var"), value.cast("double").alias("value")]


def validate(df: DataFrame) -> DataFrame:
    """Findings on structure and quality: (severity, rule, var, value)."""
    absent = [d for d in COORDS if d not in df.columns]
    cols = numeric_columns(df)
    nulls = profile_nulls(df, cols)
    parts = [nulls.where(F.col("null_pct") > 50).select(
        *_finding("warning", "null_pct", F.col("var"), F.col("null_pct")))]
    checked = present(df, CHECKED)
    if checked:
        out = detect_outliers(df, checked, "iqr", 3.0)
        parts.append(out.where(F.col("outlier_pct") > 10).select(
            *_finding("warning", "outlier_pct", F.col("var"), F.col("outlier_pct"))))
    dims = [d for d in COORDS if d in df.columns]
    if dims:
        parts.append(axis_regularity(df, dims).where(~F.col("uniform")).select(
            *_finding("warning", "irregular_axis", F.col("dim"), F.col("max_gap") - F.col("min_gap"))))
    if absent:
        spark = df.sparkSession
        rows = [("issue", "missing_dimension", d, None) for d in absent]
        parts.append(spark.createDataFrame(rows, "severity string, rule string, var string, value double"))
    return reduce(DataFrame.unionAll, parts)


def quality_checks(df: DataFrame, required: Sequence[str], time_range: tuple | None = None,
                   box: Mapping[str, tuple[float, float]] | None = None, min_valid: float = 0.3,
                   max_null_pct: float = 70.0) -> DataFrame:
    """Configured checks, one row each: rule, subject, measured value, passed."""
    names = [c for c in present(df, required) if c not in COORDS]
    spans = [d for d in COORDS if d in df.columns]
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in names],
                 *[F.min(d).alias(f"_lo_{d}") for d in spans], *[F.max(d).alias(f"_hi_{d}") for d in spans])
    lines = []

    def add(rule: str, subject: str, value: Column, ok: Column) -> None:
        lines.append(F.struct(F.lit(rule).alias("rule"), F.lit(subject).alias("subject"),
                              value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")))

    for name in [*COORDS, *required]:
        found = bool(present(df, [name]))
        add("required", name, F.lit(1.0 if found else 0.0), F.lit(found))
    for c in names:
        share = F.try_divide(F.col(c), F.col("_n"))
        add("min_valid_ratio", c, share, share >= min_valid)
        add("max_null_pct", c, (1 - share) * 100, (1 - share) * 100 <= max_null_pct)
    if time_range and "time" in spans:
        ok = (F.col("_lo_time") >= F.lit(time_range[0])) & (F.col("_hi_time") <= F.lit(time_range[1]))
        add("time_range", "time", ok.cast("double"), ok)
    for d, (a, b) in (box or {}).items():
        ok = (F.col(f"_lo_{d}") >= a) & (F.col(f"_hi_{d}") <= b)
        add("space_range", d, ok.cast("double"), ok)
    return _lines(row, lines)


def spatial_series(df: DataFrame, var: str, how: str = "mean", time: str = "time") -> DataFrame:
    """One value per time step over all positions."""
    one_of(how, AGGREGATES, "aggregation")
    if how == "median":
        return percentiles(df, [var], [0.5], by=[time]).select(time, F.col(var)[0].alias(var))
    act = {"mean": F.avg(var), "sum": F.coalesce(F.sum(var), F.lit(0.0)), "min": F.min(var), "max": F.max(var)}
    return df.groupBy(time).agg(act[how].alias(var))


def coverage(df: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """First and last time step and number of steps."""
    return df.groupBy(*by).agg(F.min(time).alias("first"), F.max(time).alias("last"),
                               F.count_distinct(time).alias("steps"))


def level_counts(df: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Rows per level, with zero for levels that do not occur."""
    counts = df.where(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("n"))
    known = df.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    return known.join(counts, "level", "full").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """One row over scored samples: counts per level, mean confidence and an assessment."""
    high = F.col("level").isin("HIGH", "CRITICAL")
    low = F.col("level").isin("LOW", "MEDIUM")
    levels = (*LEVELS, "CRITICAL")
    row = df.agg(F.count("*").alias("total_samples"),
                 *[F.count_if(F.col("level") == x).alias(f"n_{x.lower()}") for x in levels],
                 F.avg("confidence").alias("average_confidence"),
                 F.count_if(high).alias("high_risk_count"), F.count_if(low).alias("low_risk_count"))
    share = F.try_divide(F.col("high_risk_count"), F.col("total_samples"))
    # fixed values: the texts of the assessment
    text = (F.when(share > 0.3, "CRITICAL - Immediate action required")
            .when(share > 0.1, "HIGH - Monitor closely")
            .when(share.isNotNull(), "NORMAL - Regular monitoring sufficient"))
    return row.withColumn("risk_assessment", text)


def batch_stats(df: DataFrame) -> DataFrame:
    """Total, successful and high-risk records, and the share of successes (0 if there are none)."""
    row = df.agg(F.count("*").alias("total"), F.count("level").alias("successful"),
                 F.count_if(F.col("level") == "HIGH").alias("high_risk"))
    rate = F.coalesce(F.try_divide(F.col("successful"), F.col("total")), F.lit(0.0))
    return row.withColumn("success_rate", rate)


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per column."""
    wide = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                             F.min(c).cast("double").alias("min"),
                             F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    wide, q = bind(wide, percentile_row(df, cols, [0.25, 0.5, 0.75]))
    return _lines(wide, [F.struct(
        F.lit(c).alias("var"), F.col(f"{c}.n").alias("count"), F.col(f"{c}.mean").alias("mean"),
        F.col(f"{c}.std").alias("std"), F.col(f"{c}.min").alias("min"), q[c][0].alias("p25"),
        q[c][1].alias("p50"), q[c][2].alias("p75"), F.col(f"{c}.max").alias("max")) for c in cols])


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("r"))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.95,
                wide_from: int = 15) -> DataFrame:
    """Pairwise complete correlations as (a, b, r) with both triangles and the diagonal.

    With more than ``wide_from`` columns, a column correlated above ``threshold`` with an
    earlier one is left out.
    """
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(range(len(cols)), 2))
    row = df.agg(*[F.corr(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs],
                 *[F.when(F.min(cols[i]) < F.max(cols[i]), 1.0).alias(f"d_{i}") for i in range(len(cols))]
                 ) if len(cols) > 1 else df.agg(F.lit(1.0).alias("d_0"))
    drop = {}
    for j in range(len(cols)):
        strong = [F.coalesce(F.abs(F.col(f"r_{i}_{j}")) > threshold, F.lit(False)) for i in range(j)]
        drop[j] = reduce(Column.__or__, strong, F.lit(False)) if len(cols) > wide_from else F.lit(False)
    lines = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            r = F.col(f"d_{i}") if i == j else F.col(f"r_{min(i, j)}_{max(i, j)}")
            lines.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), r.alias("r"),
                                  (~(drop[i] | drop[j])).alias("keep")))
    return row.select(F.inline(F.array(*lines))).where("keep").drop("keep")


def histogram(df: DataFrame, var: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the range, the last one closed; empty bins are listed with 0."""
    held, row = bind(df.where(F.col(var).isNotNull()), one_row(df, lo=F.min(var), hi=F.max(var)))
    # a constant column is spread over one unit around its value
    lo = F.when(row["hi"] > row["lo"], row["lo"]).otherwise(row["lo"] - 0.5)
    hi = F.when(row["hi"] > row["lo"], row["hi"]).otherwise(row["hi"] + 0.5)
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col(var) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = held.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    every, _ = bind(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), one_row(df, lo=F.min(var), hi=F.max(var)))
    return every.join(counts, "bin", "left").select(
        "bin", (lo + width * F.col("bin")).alias("left_edge"), (lo + width * (F.col("bin") + 1)).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"))


#: Parts into which ``box_stats`` deals the values of a group, so that a hot group meets in no single task.
BOX_PARTS = 16


def box_stats(df: DataFrame, var: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 IQR), mean, count and outliers, per group; for any number of groups."""
    q = percentiles(df, [var], [0.25, 0.5, 0.75], by=by).withColumnRenamed(var, "_q")
    rows = df.select(*[F.col(k) for k in by], F.col(var).alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    if by:
        q = q.select(*[F.col(k).alias(f"_by_{i}") for i, k in enumerate(by)], "_q", F.explode(F.sequence(F.lit(0), F.lit(BOX_PARTS - 1))).alias("_of"))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(BOX_PARTS)).cast("int"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_by_{i}")) for i, k in enumerate(by)], F.col("_part") == F.col("_of"))
        rows = rows.join(q, same, "left")
    else:
        rows = rows.withColumn("_q", q.select("_q").scalar())
    q1, q3, v = F.col("_q")[0], F.col("_q")[2], F.col("_v")
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    count = lambda held: F.coalesce(F.sum(F.when(held, F.col("_n"))), F.lit(0))
    # the box bounds the whiskers if no value lies between fence and quartile
    return rows.groupBy(*by).agg(
        count(v.isNotNull()).alias("n"), F.try_divide(F.sum(v.cast("double") * F.col("_n")), count(v.isNotNull())).alias("mean"),
        F.min(q1).alias("q1"), F.min(F.col("_q")[1]).alias("median"), F.min(q3).alias("q3"),
        F.least(F.min(F.when(v >= low, v)), F.min(q1)).alias("whisker_low"),
        F.greatest(F.max(F.when(v <= high, v)), F.max(q3)).alias("whisker_high"),
        count((v < low) | (v > high)).alias("outliers"))


def map_centre(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def heat_cells(df: DataFrame, var: str, cell_deg: float = 1.0) -> DataFrame:
    """Density and mean of ``var`` per square of ``cell_deg`` degrees."""
    sq = lambda c: (F.floor(F.col(c) / cell_deg) * cell_deg).cast("double")
    return (df.where(F.col(var).isNotNull()).groupBy(sq("lat").alias("lat"), sq("lon").alias("lon"))
            .agg(F.count("*").alias("n"), F.avg(var).alias(var)))


def hotspots(df: DataFrame) -> DataFrame:
    """Number of points, of HIGH ones, and mean chlorophyll."""
    return df.agg(F.count("*").alias("points"), F.count_if(F.col("level") == "HIGH").alias("high_points"),
                  F.avg("chl").alias("mean_chl"))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share in % per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = one_row(counts, n=F.sum("n"))
    return counts.withColumn("pct", F.col("n") / total["n"] * 100)


def monthly_levels(df: DataFrame, ts: str = "ts", levels: Sequence[str] = LEVELS) -> DataFrame:
    """Share in % of each level per calendar month."""
    by_month = df.where(F.col("level").isNotNull()).groupBy(F.month(ts).alias("month")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("level") == x).alias(f"_{x}") for x in levels])
    return by_month.select("month", "n", *[(F.col(f"_{x}") / F.col("n") * 100).alias(f"{x.lower()}_pct")
                                           for x in levels])


def catalog(files: Mapping[str, DataFrame]) -> DataFrame:
    """Per file and variable: type, rows, missing share and attributes."""
    parts = []
    for name, df in files.items():
        attrs = {f.name: {k: str(v) for k, v in f.metadata.items()} for f in df.schema.fields}
        size = one_row(df, n=F.count("*"))
        info = profile_nulls(df)
        pick = F.lit(None).cast("map<string,string>")
        for c, a in attrs.items():
            if a:
                flat = [F.lit(x) for kv in a.items() for x in kv]
                pick = F.when(F.col("var") == c, F.create_map(*flat)).otherwise(pick)
        parts.append(info.select(F.lit(name).alias("file"), "var", "dtype", size["n"].alias("n_rows"),
                                 "null_count", "null_pct", pick.alias("attrs")))
    return reduce(DataFrame.unionAll, parts)
