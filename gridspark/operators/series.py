"""Long series: the same results when one cell holds a large part of all rows.

A grid's series is bounded by its time axis, so the operators window over whole
series.  Station-like inputs may have a few cells with very many steps; these helpers
cut such series into blocks that are processed independently.

* ``in_blocks`` runs any operator with a bounded frame on blocks with a halo.
* ``time_chunk`` and carried summaries serve operators whose reach is not bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.frames import CELL, time_number

BLOCK_ROWS = 100_000


def time_chunk(df: DataFrame, time: str = "time", piece: float | None = None) -> Column:
    """Calendar piece of a series: about a year of dates, or one day of timestamps.

    (cell, time) is unique in a grid, so a piece of dates has at most 366 rows.  For faster
    measurements ``piece`` sets another length, in days for dates and microseconds otherwise.
    """
    if piece is None:
        piece = 366.0 if isinstance(df.schema[time].dataType, T.DateType) else 86400e6
    return F.floor(time_number(df, time) / F.lit(float(piece)))


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def position(df: DataFrame, cell: Sequence[str] = CELL, time: str = "time", out: str = "_rn",
             piece: float | None = None) -> DataFrame:
    """Add the row's position (from 0) in its series.

    Rows are numbered within calendar pieces and shifted by the sizes of the pieces before.
    """
    cell = list(cell)
    placed = df.withColumn("_chunk", time_chunk(df, time, piece))
    sizes = placed.groupBy(*cell, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*cell).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*cell, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = placed.alias("d").join(sizes.alias("s"), same("d", "s", [*cell, "_chunk"])).select("d.*", "s._start")
    local = F.row_number().over(Window.partitionBy(*cell, "_chunk").orderBy(time)) - 1
    return rows.withColumn(out, F.col("_start") + local).drop("_chunk", "_start")


def in_blocks(df: DataFrame, op: Callable[[DataFrame, Sequence[str]], DataFrame], reach: int,
              cell: Sequence[str] = CELL, time: str = "time", block_rows: int = BLOCK_ROWS,
              piece: float | None = None) -> DataFrame:
    """Run ``op(df, cell)`` on blocks of consecutive rows of each series.

    ``reach`` is the number of rows the operator looks back or ahead; that many rows of
    the neighbouring blocks are copied in and removed again afterwards.
    """
    if reach >= block_rows:
        raise ValueError("blocks must be longer than the reach of the operator")
    rn = F.col("_rn")
    own = F.floor(rn / block_rows)
    homes = F.array_distinct(F.array(own, F.floor((rn - reach) / block_rows), F.floor((rn + reach) / block_rows)))
    blocks = position(df, cell, time, piece=piece).withColumn("_block", F.explode(homes))
    out = op(blocks, [*cell, "_block"])
    return out.where(F.col("_block") == own).drop("_block", "_rn")


def next_valid(df: DataFrame, cols: Sequence[str], cell: Sequence[str] = CELL, time: str = "time",
               prefix: str = "_n_", piece: float | None = None) -> DataFrame:
    """Add the next valid (t, v) strictly after each row, however far away it is.

    Found inside the calendar piece, or else carried over from the first later piece with
    a valid value; no task sees more than one piece or the summaries of one series.
    """
    cell = list(cell)
    now = time_number(df, time)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(now.alias("t"), F.col(c).alias("v"))) for c in cols}
    placed = df.withColumn("_chunk", time_chunk(df, time, piece))
    firsts = placed.groupBy(*cell, "_chunk").agg(*[
        F.min_by(known[c], F.when(F.col(c).isNotNull(), now)).alias(f"_f_{c}") for c in cols])
    later = (Window.partitionBy(*cell).orderBy(F.col("_chunk").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select(*cell, "_chunk", *[
        F.last(f"_f_{c}", ignorenulls=True).over(later).alias(f"_c_{c}") for c in cols])
    rows = placed.alias("d").join(firsts.alias("s"), same("d", "s", [*cell, "_chunk"])).select(
        "d.*", *[f"s._c_{c}" for c in cols])
    ahead = (Window.partitionBy(*cell, "_chunk").orderBy(F.col(time).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({f"{prefix}{c}": F.coalesce(
        F.last(known[c], ignorenulls=True).over(ahead), F.col(f"_c_{c}")) for c in cols})
    return rows.drop("_chunk", *[f"_c_{c}" for c in cols])


def plain_next_valid(df: DataFrame, cols: Sequence[str], cell: Sequence[str] = CELL, time: str = "time",
                     prefix: str = "_n_") -> DataFrame:
    """The same on whole series, sharing the shuffle of the other series windows."""
    now = time_number(df, time)
    # looking ahead as "last value" of the reversed order lets the frame grow row by row
    ahead = (Window.partitionBy(*cell).orderBy(F.col(time).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(now.alias("t"), F.col(c).alias("v"))) for c in cols}
    return df.withColumns({f"{prefix}{c}": F.last(known[c], ignorenulls=True).over(ahead) for c in cols})
