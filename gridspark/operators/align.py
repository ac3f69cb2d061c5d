"""Joins, alignment, set operations and nearest neighbours on grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS, bind, need, one_row, present, spread
from gridspark.operators.text import name_contains, names_overlap


def merge_grids(grids: Sequence[DataFrame], on: Sequence[str] = COORDS) -> DataFrame:
    """All cells of all grids, one row each; a variable found twice keeps the first grid's column.

    One union and one grouping, however many grids there are.  Cells are unique within a grid.
    """
    have: dict[str, str] = {}
    parts = []
    for g in grids:
        fresh = [c for c in g.columns if c.lower() not in have and c not in on]
        have.update({c.lower(): c for c in fresh})
        parts.append(g.select(*on, *fresh))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in have.values()]) if have else rows.distinct()


def axis(df: DataFrame, dim: str) -> DataFrame:
    """Distinct values of one coordinate with their position from 0 (an axis, not the data)."""
    values = df.select(dim).where(F.col(dim).isNotNull()).distinct()
    return values.withColumn(f"{dim}_idx", (F.row_number().over(Window.orderBy(dim)) - 1).cast("long"))


def lookup_by_coords(points: DataFrame, grids: Sequence[DataFrame]) -> DataFrame:
    """Every variable of every grid at the points' coordinates, NULL where absent."""
    out = points
    for g in grids:
        have = {c.lower() for c in out.columns}
        fresh = [c for c in g.columns if c.lower() not in have]
        out = out.join(g.select(*COORDS, *fresh), list(COORDS), "left")
    return out


def lookup_by_position(points: DataFrame, grids: Sequence[DataFrame]) -> DataFrame:
    """Every variable of every grid at axis positions (``time_idx, lat_idx, lon_idx``), NULL where absent.

    The points are translated to coordinates; a grid is joined once, on its coordinates.
    """
    out = points
    for g in grids:
        have = {c.lower() for c in out.columns}
        fresh = [c for c in g.columns if c.lower() not in have and c not in COORDS]
        own = {d: f"_{d}" for d in COORDS}
        placed = reduce(lambda d, dim: d.join(axis(g, dim).withColumnsRenamed(own), f"{dim}_idx", "left"), COORDS, out)
        cells = g.select(*COORDS, *fresh).withColumnsRenamed(own)
        out = placed.join(cells, list(own.values()), "left").select(*out.columns, *fresh)
    return out


def densify(df: DataFrame) -> DataFrame:
    """All combinations of the axes; cells without a row get NULL variables.

    The axes are short arrays; exploding them next to each time step spreads the
    product over the cluster.
    """
    need(df, *COORDS)
    arrays = one_row(df, lat=F.sort_array(F.collect_set("lat")), lon=F.sort_array(F.collect_set("lon")))
    dense = (df.select("time").where(F.col("time").isNotNull()).distinct()
             .select("time", F.explode(arrays["lat"]).alias("lat"))
             .select("time", "lat", F.explode(arrays["lon"]).alias("lon")))
    return dense.join(df, list(COORDS), "left")


def nearest_axis_value(df: DataFrame, dim: str, x: float) -> Column:
    """The axis value closest to ``x`` (the lower one on a tie), as a scalar subquery."""
    best = F.min_by(dim, F.struct(F.abs(F.col(dim) - F.lit(float(x))), F.col(dim)))
    return df.agg(best).scalar()


def series_at(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """The series of the grid point nearest in latitude and, independently, in longitude."""
    return df.where((F.col("lat") == nearest_axis_value(df, "lat", lat))
                    & (F.col("lon") == nearest_axis_value(df, "lon", lon)))


def missing_variables(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (file, var) pairs for which the file has no variable with a similar name."""
    e, a = expected.alias("e"), actual.select("file", "var").distinct().alias("a")
    return e.join(a, (F.col("e.file") == F.col("a.file"))
                  & names_overlap(F.col("e.var"), F.col("a.var")), "left_anti")


def with_days(df: DataFrame, days: int, anchor) -> DataFrame:
    """Repeat each row for ``days`` consecutive dates, the anchor date first."""
    return (df.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
            .withColumn("date", F.date_add(F.lit(anchor).cast("date"), F.col("day"))))


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    return forecast.join(actual, list(on), "left")


def drop_records(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def concat_time(grids: Sequence[DataFrame]) -> DataFrame:
    """All rows of all grids; variables a grid lacks are NULL, duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), grids)


def common_variables(catalog: DataFrame) -> DataFrame:
    """Variables every file has."""
    files = one_row(catalog, n=F.count_distinct("file"))
    counts = catalog.groupBy("var").agg(F.count_distinct("file").alias("n_files"))
    return counts.where(F.col("n_files") == files["n"])


def file_variables(catalog: DataFrame) -> DataFrame:
    """The sorted variable names of every file."""
    return catalog.groupBy("file").agg(F.sort_array(F.collect_set("var")).alias("variables"))


def requested_minus_available(requested: DataFrame, available: DataFrame) -> DataFrame:
    return requested.exceptAll(available)


def find_reference(catalog: DataFrame, part: str = "CHL") -> DataFrame:
    """The first (file, var) whose name contains ``part``, else the first of all."""
    hit = name_contains(F.col("var"), part)
    best = F.min_by(F.struct("file", "var"), F.struct((~hit).cast("int"), F.col("pos")))
    return catalog.agg(best.alias("b")).select("b.*")


def check_compatible(a: DataFrame, b: DataFrame, dims: Sequence[str] = ("lat", "lon"),
                     rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per dimension: positions present on one side only, and positions that differ."""
    parts = []
    for d in dims:
        if not (present(a, [d]) and present(b, [d])):
            raise ValueError(f"dimension {d} is not in both grids")
        x = axis(a, d).withColumnRenamed(d, "a")
        y = axis(b, d).withColumnRenamed(d, "b")
        far = F.abs(F.col("a") - F.col("b")) > atol + rtol * F.abs(F.col("b"))
        parts.append(x.join(y, f"{d}_idx", "full").agg(
            F.lit(d).alias("dim"),
            F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
            F.count_if(far).alias("different")))
    out = reduce(DataFrame.unionAll, parts)
    return out.withColumn("compatible", (F.col("unmatched") == 0) & (F.col("different") == 0))


# Longitudes handled side by side in one pandas group of fill_spatial_nearest.
STRIP = 64


def _fill_strip(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """Nearest values along latitude of variable ``k`` for a strip of columns, given the nearest ones per row.

    Looks one latitude further each step and stops when no cell can improve, so a
    strip costs as many vector operations as its longest distance in rows.
    """
    lats, y = np.unique(pdf["lat"].to_numpy(), return_inverse=True)
    lons, x = np.unique(pdf["lon"].to_numpy(), return_inverse=True)
    shape = (len(lats), len(lons))
    d0, lon0, v0 = np.full(shape, np.inf), np.full(shape, np.inf), np.full(shape, np.nan)
    d0[y, x] = pdf[f"_d2{k}"].fillna(np.inf).to_numpy(dtype=float)
    lon0[y, x] = pdf[f"_lon{k}"].fillna(np.inf).to_numpy(dtype=float)
    v0[y, x] = pdf[f"_v{k}"].to_numpy(dtype=float)
    best, best_lat, best_v = d0.copy(), np.repeat(lats[:, None], shape[1], axis=1), v0.copy()
    best_lon = lon0.copy()
    for step in range(1, len(lats)):
        gap = (lats[step:] - lats[:-step]) ** 2
        if np.all(gap[:, None] > np.maximum(best[step:], best[:-step])):
            break
        for dst, src in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            d = gap[:, None] + d0[src]
            at = np.repeat(lats[src][:, None], shape[1], axis=1)
            closer = (d < best[dst]) | ((d == best[dst]) & np.isfinite(d) & (
                (at < best_lat[dst]) | ((at == best_lat[dst]) & (lon0[src] < best_lon[dst]))))
            best[dst] = np.where(closer, d, best[dst])
            best_lat[dst] = np.where(closer, at, best_lat[dst])
            best_lon[dst] = np.where(closer, lon0[src], best_lon[dst])
            best_v[dst] = np.where(closer, v0[src], best_v[dst])
    return best_v[y, x]


def fill_spatial_nearest(df: DataFrame, var: str | Sequence[str], min_valid: int = 10) -> DataFrame:
    """Fill each missing cell of a time slice with its nearest valid cell (degrees, Euclidean), for one variable or several.

    Ties take the lowest (lat, lon).  A variable with fewer than ``min_valid`` valid cells in a slice
    stays as it is there.  Slices must be dense (see ``densify``).  Two exact passes: window functions find the nearest valid cell
    within the row of equal latitude, then strips of neighbouring columns look along
    latitude.  All variables share both passes, so the plan does not grow with their number.  The largest group is one
    row or one strip of one slice; strips hold equal numbers of longitudes, however these are spaced.
    """
    cols = [var] if isinstance(var, str) else list(var)
    need(df, *COORDS, *cols)
    if not cols:
        return df
    ids = range(len(cols))
    counts = df.groupBy("time").agg(F.count("*").alias("_cells"), *[F.count(c).alias(f"_n{k}") for k, c in enumerate(cols)])
    todo = counts.select("time", *[((F.col(f"_n{k}") >= min_valid) & (F.col(f"_n{k}") < F.col("_cells"))).alias(f"_do{k}") for k in ids])
    todo = todo.where(reduce(lambda a, b: a | b, [F.col(f"_do{k}") for k in ids]))
    upto = (Window.unboundedPreceding, 0)
    right = Window.partitionBy("time", "lat").orderBy("lon").rowsBetween(*upto)
    left = Window.partitionBy("time", "lat").orderBy(F.col("lon").desc()).rowsBetween(*upto)

    def here(k: int, c: str) -> Column:
        return F.when(F.col(f"_do{k}") & F.col(c).isNotNull(), F.struct(F.col("lon"), F.col(c).cast("double").alias("v")))

    def picked(k: int) -> Column:
        w, e = F.col(f"_w{k}"), F.col(f"_e{k}")
        return F.when(e.isNull() | (F.col("lon") - w["lon"] <= e["lon"] - F.col("lon")), w).otherwise(e)

    near = df.select(*COORDS, *cols).join(todo, "time")
    near = near.withColumns({f"_w{k}": F.last(here(k, c), ignorenulls=True).over(right) for k, c in enumerate(cols)})
    near = near.withColumns({f"_e{k}": F.last(here(k, c), ignorenulls=True).over(left) for k, c in enumerate(cols)})
    near = near.withColumns({f"_p{k}": picked(k) for k in ids})
    gaps = [(F.col(f"_do{k}") & F.col(c).isNull()).alias(f"_gap{k}") for k, c in enumerate(cols)]
    near = near.select(*COORDS, *gaps, *[x for k in ids for x in (
        F.pow(F.col("lon") - F.col(f"_p{k}.lon"), F.lit(2)).alias(f"_d2{k}"),
        F.col(f"_p{k}.lon").alias(f"_lon{k}"), F.col(f"_p{k}.v").alias(f"_v{k}"))])
    # the first longitude of every strip; an axis is no larger than one row of a slice
    axis_ = F.sort_array(F.collect_set("lon"))
    heads = df.agg(F.filter(axis_, lambda x, i: i % STRIP == 0).alias("s")).scalar()
    near, heads = bind(near, heads)
    near = near.withColumn("_strip", F.size(F.filter(heads, lambda x: x <= F.col("lon")))).drop("_row")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lat", "lon"], kind="stable")
        out = pdf[["time", "lat", "lon"]].copy()
        wanted = np.zeros(len(pdf), dtype=bool)
        for k in ids:
            gap = pdf[f"_gap{k}"].to_numpy(dtype=bool)
            out[f"_fill{k}"] = np.where(gap, _fill_strip(pdf, k), np.nan) if gap.any() else np.nan
            wanted |= gap
        return out[wanted]

    times = df.schema["time"].dataType.simpleString()
    filled = spread(near, "time", "_strip").groupBy("time", "_strip").applyInPandas(
        fill, f"time {times}, lat double, lon double, " + ", ".join(f"_fill{k} double" for k in ids))
    return (df.join(filled, list(COORDS), "left")
            .withColumns({c: F.coalesce(F.col(c), F.nanvl(f"_fill{k}", F.lit(None)).cast(df.schema[c].dataType)) for k, c in enumerate(cols)})
            .drop(*[f"_fill{k}" for k in ids]))
