"""Repeatable samples and splits of exact size, without sorting the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.draws import draw, draw_cuts
from gridspark.functions.frames import COORDS, as_scalar, bind, lookup, one_row


def sample_cells(df: DataFrame, var: str, n: int = 50_000, seed: int = 42,
                 keys: Sequence[str] = COORDS) -> DataFrame:
    """``n`` cells with a value in ``var``, without replacement (all of them if there are fewer)."""
    valid = df.where(F.col(var).isNotNull())
    cut = as_scalar(draw_cuts(valid, seed, keys, {"cut": F.least(F.col("n"), F.lit(n))}))
    return valid.where(draw(seed, keys) <= F.coalesce(cut["cut"], F.lit("")))


def unravel(df: DataFrame, idx: str, n_lat: int, n_lon: int) -> DataFrame:
    """Flat index to ``time_idx, lat_idx, lon_idx`` of a dense time-lat-lon block."""
    i = F.col(idx)
    plane = n_lat * n_lon
    return df.withColumns({"time_idx": F.floor(i / plane).cast("long"),
                           "lat_idx": F.floor(i % plane / n_lon).cast("long"),
                           "lon_idx": (i % n_lon).cast("long")})


def _part(size: Column, share: float) -> Column:
    return F.floor(size * F.lit(float(share)))


def split(df: DataFrame, keys: Sequence[str], test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly int(n*test) test and int(n*val) validation rows, the rest train.

    ``keys`` identify a row.  Two thresholds on the draw decide, so the data is not shuffled.
    """
    n = F.col("n")
    cuts = draw_cuts(df, seed, keys, {"test": _part(n, test), "val": _part(n, test) + _part(n, val)})
    held, cuts = bind(df, as_scalar(cuts))
    h = draw(seed, keys)
    name = F.when(h <= cuts["test"], "test").when(h <= cuts["val"], "val").otherwise("train")
    return held.withColumn("split", name).drop("_row")


def split_stratified(df: DataFrame, label: str, keys: Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """The same split within every class: int(n_class*test) test rows, the rest train."""
    cuts = draw_cuts(df, seed, keys, {"_cut": _part(F.col("n"), test)}, by=[label])
    cut = F.coalesce(lookup(cuts, [label], "_cut"), F.lit(""))
    return df.withColumn("split", F.when(draw(seed, keys) <= cut, "test").otherwise("train"))


def split_temporal(df: DataFrame, test: float = 0.2, val: float = 0.1, time: str = "time") -> DataFrame:
    """The latest rows are test, those before validation, the earliest train.

    The percent rank of a row depends on its time step only; steps are counted first.
    """
    steps = df.groupBy(time).agg(F.count("*").alias("_n"))
    before = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)  # one row per time step
    steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    total = one_row(steps, n=F.sum("_n"))
    rank = F.coalesce(F.try_divide(F.col("_before"), total["n"] - 1), F.lit(0.0))
    name = (F.when(rank >= F.lit(1.0 - test), "test").when(rank >= F.lit(1.0 - test - val), "val")
            .otherwise("train"))
    steps = steps.select(time, name.alias("split"))
    return df.join(steps, time, "left")


def folds(df: DataFrame, keys: Sequence[str], k: int = 5, label: str | None = None, seed: int = 42,
          out: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1 of equal size, within each class if ``label`` is given."""
    by = [label] if label else []
    n = F.col("n")
    names = [f"_c{i}" for i in range(k)]
    cuts = draw_cuts(df, seed, keys, {c: F.floor(n * (i + 1) / k) for i, c in enumerate(names)}, by=by)
    ends = lookup(cuts.select(*by, F.struct(*names).alias("_ends")), by, "_ends") if by else as_scalar(cuts)
    rows, row = bind(df, ends)
    cut = lambda i: F.coalesce(row[f"_c{i}"], F.lit(""))
    h = draw(seed, keys)
    number = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        number = F.when(h <= cut(i), i).otherwise(number)
    return rows.withColumn(out, number.cast("int")).drop("_row")


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_class) on every row."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    held, total = bind(counts, one_row(counts, n=F.sum("_n"), k=F.count("*")))
    weights = held.select(label, (total["n"] / (total["k"] * F.col("_n"))).alias(out))
    return df.withColumn(out, lookup(weights, [label], out))
