"""Scaling with parameters fitted in one pass over all variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import as_scalar, bind, one_of, one_row
from gridspark.functions.quantiles import percentile_row

METHODS = ("standard", "minmax", "robust", "log", "power")
EPS = 1e-10


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard",
          bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Scale ``cols`` by their own statistics."""
    one_of(method, METHODS, "scaling method")
    v = {c: F.col(c) for c in cols}
    if method == "standard":
        held, row = bind(df, one_row(df, **{f"m_{c}": F.avg(c) for c in cols},
                                     **{f"s_{c}": F.stddev_pop(c) for c in cols}))
        out = {c: (v[c] - row[f"m_{c}"]) / (row[f"s_{c}"] + EPS) for c in cols}
    elif method == "robust":
        held, row = bind(df, percentile_row(df, cols, [0.25, 0.5, 0.75]))
        out = {c: (v[c] - row[c][1]) / (row[c][2] - row[c][0] + EPS) for c in cols}
    else:
        held, row = bind(df, one_row(df, **{f"lo_{c}": F.min(c) for c in cols},
                                     **{f"hi_{c}": F.max(c) for c in cols}))
        if method == "minmax":
            a, b = (float(x) for x in bounds)

            def spread(c: str) -> Column:
                width = row[f"hi_{c}"] - row[f"lo_{c}"]
                return F.when(width > 0, (v[c] - row[f"lo_{c}"]) / width * (b - a) + a).otherwise(v[c])

            out = {c: spread(c) for c in cols}
        elif method == "log":
            out = {c: F.log1p(v[c] + F.when(row[f"lo_{c}"] <= 0, 1 - row[f"lo_{c}"]).otherwise(0.0))
                   for c in cols}
        else:
            out = {c: F.when(row[f"lo_{c}"] >= 0, F.sqrt(F.abs(v[c])))
                   .otherwise(F.signum(v[c]) * F.sqrt(F.abs(v[c]))) for c in cols}
    return held.withColumns(out).drop("_row")


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of mean and population deviation per column; a constant column divides by 1."""
    aggs = []
    for c in cols:
        s = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(s == 0, F.lit(1.0)).otherwise(s).alias(f"{c}_std")]
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale any split with fitted parameters."""
    held, row = bind(df, as_scalar(params))
    return held.withColumns({c: (F.col(c) - row[f"{c}_mean"]) / row[f"{c}_std"] for c in cols}).drop("_row")
