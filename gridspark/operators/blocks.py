"""User functions on tiles, series and partitions (Arrow batches)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import CELL, COORDS, bind, one_row, spread

PandasFn = Callable[[pd.DataFrame], pd.DataFrame]


def tile_of(dim: str, size: float) -> Column:
    return F.floor(F.col(dim) / size).cast("long")


def with_tiles(df: DataFrame, tile: float, per_step: bool = True) -> tuple[DataFrame, list[str]]:
    """Add tile numbers; a tile is ``tile`` degrees square, of one time step by default."""
    out = df.withColumns({"tile_lat": tile_of("lat", tile), "tile_lon": tile_of("lon", tile)})
    return out, [*(["time"] if per_step else []), "tile_lat", "tile_lon"]


def apply_blocks(df: DataFrame, fn: PandasFn, schema: str, tile: float = 4.0, per_step: bool = True) -> DataFrame:
    """``fn`` on the rows of every tile."""
    tiled, keys = with_tiles(df, tile, per_step)
    return spread(tiled, *keys).groupBy(*keys).applyInPandas(fn, schema)


def _reflect(pdf: pd.DataFrame, dim: str, lo: float, hi: float, edge_lo: bool, edge_hi: bool,
             halo: float) -> pd.DataFrame:
    """Mirror the rows next to the grid's edge beyond it, edge row included."""
    axis = np.sort(pdf[dim].unique())
    gap = float(np.min(np.diff(axis))) if len(axis) > 1 else 0.0
    parts = [pdf]
    if edge_lo and gap:
        near = pdf[pdf[dim] < lo + halo]
        parts.append(near.assign(**{dim: 2 * lo - gap - near[dim], "_core": False}))
    if edge_hi and gap:
        near = pdf[pdf[dim] > hi - halo]
        parts.append(near.assign(**{dim: 2 * hi + gap - near[dim], "_core": False}))
    return pd.concat(parts, ignore_index=True)


def apply_overlap(df: DataFrame, fn: PandasFn, tile: float = 4.0, halo: float = 1.0) -> DataFrame:
    """``fn`` on tiles extended by ``halo`` degrees; only core cells are kept.

    ``fn`` gets and returns the columns of ``df``, row by row in the same order.  Beyond
    the edge of the grid the border rows are mirrored.
    """
    if halo > tile:
        raise ValueError("the halo must not be wider than a tile")
    held, edges = bind(df, one_row(df, y0=F.min("lat"), y1=F.max("lat"), x0=F.min("lon"), x1=F.max("lon")))
    spots = [F.array_distinct(F.array(tile_of(d, tile), F.floor((F.col(d) - halo) / tile).cast("long"),
                                      F.floor((F.col(d) + halo) / tile).cast("long"))) for d in CELL]
    own = [tile_of(d, tile) for d in CELL]
    copies = (held.withColumn("_ty", F.explode(spots[0])).withColumn("_tx", F.explode(spots[1]))
              .withColumn("_core", (F.col("_ty") == own[0]) & (F.col("_tx") == own[1]))
              .withColumns({f"_{k}": edges[k] for k in ("y0", "y1", "x0", "x1")}).drop("_row"))
    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_core"].any():
            return pdf[names].iloc[0:0]
        ty, tx = int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0])
        y0, y1, x0, x1 = (float(pdf[f"_{k}"].iloc[0]) for k in ("y0", "y1", "x0", "x1"))
        full = pdf[[*names, "_core"]]
        full = _reflect(full, "lat", y0, y1, ty * tile <= y0, (ty + 1) * tile > y1, halo)
        full = _reflect(full, "lon", x0, x1, tx * tile <= x0, (tx + 1) * tile > x1, halo)
        full = full.sort_values(list(COORDS), kind="stable").reset_index(drop=True)
        core = full["_core"].to_numpy(dtype=bool)
        return fn(full[names]).loc[core, names]

    keys = ("time", "_ty", "_tx")
    return spread(copies, *keys).groupBy(*keys).applyInPandas(run, df.schema)


def reduce_blocks(df: DataFrame, fn: PandasFn, schema: str, tile: float = 4.0, fan_in: int = 256) -> DataFrame:
    """Reduce with a user function: first per tile and time step, then in a tree.

    ``fn`` maps rows to few rows of the same shape and must be associative.  Every round
    groups about ``fan_in`` partial results, so no group grows with the data.
    """
    tiled, keys = with_tiles(df, tile)
    parts = spread(tiled, *keys).groupBy(*keys).applyInPandas(_numbered(fn), schema + ", _g long")
    for groups in (fan_in * fan_in, fan_in):
        parts = (parts.withColumn("_g", F.col("_g") % groups).groupBy("_g")
                 .applyInPandas(_numbered(fn, "_g"), schema + ", _g long"))
    return parts.drop("_g").groupBy().applyInPandas(fn, schema)


def _numbered(fn: PandasFn, drop: str | None = None):
    """``fn`` with a number per group that is the same on every attempt of a task."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0]) if drop else zlib.crc32(repr(tuple(str(k) for k in key)).encode())
        return fn(pdf.drop(columns=drop) if drop else pdf).assign(_g=number)
    return run


def map_batches(df: DataFrame, fn: PandasFn, schema: str) -> DataFrame:
    """``fn`` on Arrow batches of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def apply_series(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], cols: Sequence[str],
                 cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """A 1-d function along time for every cell; the named columns become its result."""
    cols = list(cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        return pdf.assign(**{c: fn(pdf[c].to_numpy(dtype=float)) for c in cols})

    return spread(df, *cell).groupBy(*cell).applyInPandas(run, df.schema)
