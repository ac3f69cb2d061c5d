"""Outlier detection and handling by global statistics of each variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import bind, one_of, one_row
from gridspark.functions.quantiles import percentile_row

METHODS = ("iqr", "zscore", "modified_zscore")
HANDLING = ("clip", "winsorize", "impute", "remove")


def _fences(row: Column, c: str, k: float) -> tuple[Column, Column]:
    q1, q3 = row[c][0], row[c][1]
    return q1 - F.lit(float(k)) * (q3 - q1), q3 + F.lit(float(k)) * (q3 - q1)


def outlier_flags(df: DataFrame, cols: Sequence[str], method: str = "iqr", k: float = 3.0) -> DataFrame:
    """Add a BOOLEAN ``<col>_outlier`` per variable, NULL where the value is missing."""
    one_of(method, METHODS, "outlier method")
    if method == "iqr":
        held, row = bind(df, percentile_row(df, cols, [0.25, 0.75]))
        flag = {c: (F.col(c) < _fences(row, c, k)[0]) | (F.col(c) > _fences(row, c, k)[1]) for c in cols}
    elif method == "zscore":
        held, row = bind(df, one_row(df, **{f"m_{c}": F.avg(c) for c in cols},
                                     **{f"s_{c}": F.stddev_pop(c) for c in cols}))
        flag = {c: F.coalesce(F.abs(F.try_divide(F.col(c) - row[f"m_{c}"], row[f"s_{c}"])) > k,
                              F.when(F.col(c).isNotNull(), F.lit(False))) for c in cols}
    else:
        held, med = bind(df, percentile_row(df, cols, [0.5]), "_med")
        away = held.select(*[F.abs(F.col(c) - med[c][0]).alias(c) for c in cols])
        held, mad = bind(held, percentile_row(away, cols, [0.5]))
        flag = {c: F.abs(0.6745 * (F.col(c) - med[c][0]) / (mad[c][0] + 1e-10)) > k for c in cols}
    return held.withColumns({f"{c}_outlier": f for c, f in flag.items()}).drop("_row", "_med")


def detect_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", k: float = 3.0) -> DataFrame:
    """Per variable: number of outliers, share of valid values in %, and for ``iqr`` the
    1st and 99th percentile as reported bounds."""
    flagged = outlier_flags(df, cols, method, k)
    counts = flagged.agg(*[F.struct(F.count(c).alias("n"), F.count_if(f"{c}_outlier").alias("o")).alias(c)
                           for c in cols])
    bounds = None
    if method == "iqr":
        counts, bounds = bind(counts, percentile_row(df, cols, [0.01, 0.99]))

    def line(c: str) -> Column:
        n, o = F.col(f"{c}.n"), F.col(f"{c}.o")
        low = bounds[c][0] if bounds is not None else F.lit(None).cast("double")
        high = bounds[c][1] if bounds is not None else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("var"), o.alias("outlier_count"),
                        (F.try_divide(o, n) * 100).alias("outlier_pct"), low.alias("lower_bound"),
                        high.alias("upper_bound"), n.alias("_n"))

    return counts.select(F.inline(F.array(*[line(c) for c in cols]))).where("_n > 0").drop("_n")


def clip_outliers(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to two percentiles; missing values stay missing."""
    held, row = bind(df, percentile_row(df, cols, [low, high]))
    return held.withColumns({
        c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), row[c][1]), row[c][0]))
        for c in cols}).drop("_row")


def winsorize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return clip_outliers(df, cols, 0.05, 0.95)


def impute_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Values outside the fences become the median."""
    held, row = bind(df, percentile_row(df, cols, [0.25, 0.75, 0.5]))

    def fixed(c: str) -> Column:
        low, high = _fences(row, c, k)
        return F.when((F.col(c) < low) | (F.col(c) > high), row[c][2]).otherwise(F.col(c))

    return held.withColumns({c: fixed(c) for c in cols}).drop("_row")


def drop_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> DataFrame:
    """Rows where no variable is missing, infinite or outside its fences."""
    held, row = bind(df, percentile_row(df, cols, [0.25, 0.75]))
    keep = F.lit(True)
    for c in cols:
        low, high = _fences(row, c, k)
        keep = keep & F.col(c).between(low, high) & (F.abs(F.col(c)) < float("inf"))
    return held.where(keep).drop("_row")


def handle_outliers(df: DataFrame, cols: Sequence[str], method: str = "clip") -> DataFrame:
    one_of(method, HANDLING, "outlier handling")
    act = {"clip": clip_outliers, "winsorize": winsorize, "impute": impute_outliers, "remove": drop_outliers}
    return act[method](df, cols)
