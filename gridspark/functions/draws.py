"""Repeatable random order: rows ordered by an MD5 of a seed and a unique key.

The order is the same on every run and every engine.  Picking the first k rows of
it needs no sort of the data: bucket counts locate the bucket with the k-th row,
only that bucket is ordered, and the k-th hash becomes a threshold all rows are
compared with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, keys: Sequence[str]) -> Column:
    """MD5 of ``seed|key|key...`` as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


#: Hex digits that a level of buckets adds: 65,536 buckets, and as many in the one that is wanted.
DIGITS = 4


def draw_cuts(df: DataFrame, seed: int | str, keys: Sequence[str], sizes: dict[str, Column],
              by: Sequence[str] = ()) -> DataFrame:
    """Per group the largest hash among the first ``sizes[name]`` rows, one column per name.

    A size is an expression over ``n``, the number of rows in the group.  A size of
    zero gives an empty string, which no hash reaches.  Two levels of buckets leave one row in
    2^32 to be ordered.
    """
    by = list(by)
    rows = df.select(*by, draw(seed, keys).alias("_h"))
    slot = F.substring("_h", 1, DIGITS).alias("_slot")
    slots = rows.groupBy(*by, slot).agg(F.count("*").alias("_c"))
    slots = slots.withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))  # at most 65,536 slots per group
    named = [F.struct(F.lit(k).alias("_name"), e.cast("long").alias("_k")) for k, e in sizes.items()]
    coarse = _wanted(slots.select(*by, "_slot", "_c", F.inline(F.array(*named))), by)
    inside = _inside(rows, coarse, by, DIGITS)
    fine = inside.groupBy(*by, "_name", "_k", F.substring("_h", 1, 2 * DIGITS).alias("_slot")).agg(F.count("*").alias("_c"))
    inside = _inside(rows, _wanted(fine, by), by, 2 * DIGITS)
    pos = F.row_number().over(Window.partitionBy(*by, "_name").orderBy("_h"))
    found = inside.withColumn("_pos", pos).where(F.col("_pos") == F.col("_k"))
    cuts = [F.coalesce(F.max(F.when(F.col("_name") == k, F.col("_h"))), F.lit("")).alias(k) for k in sizes]
    return found.groupBy(*by).agg(*cuts)


def _wanted(slots: DataFrame, by: list[str]) -> DataFrame:
    """The slot that holds the ``_k``-th row of each name, and the row's number in that slot."""
    upto = Window.partitionBy(*by, "_name").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_c").over(upto) - F.col("_c")
    return (slots.withColumn("_k", F.col("_k") - before).where((F.col("_k") > 0) & (F.col("_k") <= F.col("_c")))
            .select(*by, "_name", "_slot", "_k"))


def _inside(rows: DataFrame, goal: DataFrame, by: list[str], digits: int) -> DataFrame:
    """Rows in the wanted slots, with the names that want them; without groups the goal has one row per name."""
    rows = rows.withColumn("_slot", F.substring("_h", 1, digits))
    cond = F.col("r._slot") == F.col("g._slot")
    for k in by:
        cond = cond & F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
    hit = (F.broadcast(goal) if not by else goal).alias("g")
    return rows.alias("r").join(hit, cond).select(*[F.col(f"r.{k}") for k in by], "r._h", "g._name", "g._k")
