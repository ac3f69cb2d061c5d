"""Exact percentiles (linear interpolation) that stay distributed, by one method at every size.

Values fall into buckets that depend on the value alone: the power of two, cut into 2^12 parts, each cut into 2^14.
Counts of the coarse parts tell which of them hold a wanted rank; of those the fine parts are counted, and only
values in the right fine parts are ordered.

Without groups this takes two scans for any number of columns.  The first makes a quantile sketch whose ranks are off by at most
n / ``ACCURACY``, so a bracket of values around each wanted rank is certain; the second counts what is outside the brackets and keeps the
values inside, equal ones together, and that one exchange serves all buckets.  With groups the rows themselves are bucketed, in three scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.frames import as_scalar, bind

COARSE_BITS, FINE_BITS = 12, 14
ACCURACY = 10_000
OFFSET = 1100 << COARSE_BITS  # above all exponents of doubles


def _buckets(v: Column) -> tuple[Column, Column]:
    """Coarse and fine bucket of a double; pairs never fall as values rise.  Infinities have buckets of their own."""
    size = F.abs(v)
    power = F.least(F.floor(F.log2(size)), F.lit(1023))
    part = (size / F.pow(F.lit(2.0), power) - 1) * float(1 << COARSE_BITS)
    coarse = F.floor(part)
    fine = F.least(F.floor((part - coarse) * float(1 << FINE_BITS)), F.lit((1 << FINE_BITS) - 1))
    sign = F.signum(v).cast("long")
    plain = (size > 0) & (size < float("inf"))
    return (F.when(plain, sign * (power * (1 << COARSE_BITS) + coarse + OFFSET)).otherwise(
                F.when(size > 0, sign * (2 * OFFSET)).otherwise(0)).cast("long"),
            F.when(plain, sign * fine).otherwise(0).cast("long"))


def _running(by: Sequence[str], order: str | Sequence[str], count: str = "_c") -> Column:
    w = Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))
    return F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _bracketed(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Counts ``_var, _v, _c`` of values, where those outside all brackets stand at the end of one next to them.

    A bracket reaches four times the sketch's error to both sides of a rank, so its ends lie on either side of the wanted values, and
    what is moved to an end shifts no rank beyond it.  Up to ``ACCURACY`` values no bracket is needed.
    """
    slack = 4 / ACCURACY
    at = [q for p in probs for q in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = F.percentile_approx
    ends = as_scalar(df.agg(*[F.struct(F.count(c).alias("n"), sketch(F.col(c).cast("double"), F.array(*map(F.lit, at)), ACCURACY).alias("q")).alias(f"s{i}")
                              for i, c in enumerate(cols)]))
    held, row = bind(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]), ends, "_ends")

    def moved(i: int) -> Column:
        v, q = F.col(f"v{i}"), row[f"s{i}"]["q"]
        lows, highs = [[q[2 * j + k] for j in range(len(probs))] for k in (0, 1)]
        inside = row[f"s{i}"]["n"] <= ACCURACY
        for p, low, high in zip(probs, lows, highs):
            inside = inside | (((v >= low) if p > slack else F.lit(True)) & ((v <= high) if p < 1 - slack else F.lit(True)))
        below = F.array_max(F.filter(F.array(*highs), lambda h: h <= v))
        return F.when(v.isNull() | inside, v).otherwise(F.coalesce(below, F.array_min(F.array(*lows))))

    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("_var"), moved(i).alias("_v")) for i, c in enumerate(cols)]))
    return held.select(pairs).where(F.col("_v").isNotNull()).groupBy("_var", "_v").agg(F.count("*").alias("_c"))


def percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` group; each of ``cols`` becomes an array with one entry per prob, NULL without values."""
    cols, probs, by = list(cols), [float(p) for p in probs], list(by)
    keys = [*by, "_var"]
    small = F.broadcast if not by else (lambda d: d)  # without groups: at most two rows per column and prob
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_v")) for c in cols]))
    b1, b2 = _buckets(F.col("_v"))
    data = (df.select(*by, pairs).where(F.col("_v").isNotNull()).withColumn("_c", F.lit(1).cast("long")) if by
            else _bracketed(df, cols, probs)).withColumns({"_b1": b1, "_b2": b2})

    def joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        cond = None
        for k in on:
            one = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
            cond = one if cond is None else cond & one
        extra = [F.col(f"r.{c}") for c in right.columns if c not in on]
        return left.alias("l").join(small(right).alias("r"), cond).select("l.*", *extra)

    def ranks(p: float) -> tuple[Column, Column]:
        spot = (F.col("_n") - 1) * F.lit(p)
        return F.floor(spot), F.ceil(spot)

    def holds() -> Column:
        found = F.lit(False)
        for r in (r for p in probs for r in ranks(p)):
            found = found | ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")))
        return found

    if by:
        coarse = data.groupBy(*keys, "_b1").agg(F.sum("_c").alias("_c"))
        coarse = coarse.withColumns({"_before": _running(keys, "_b1"), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
        coarse = coarse.where(holds()).select(*keys, "_b1", "_n", F.col("_before").alias("_base"))
        fine = joined(data, coarse, [*keys, "_b1"]).groupBy(*keys, "_b1", "_b2", "_base", "_n").agg(F.sum("_c").alias("_c"))
        fine = fine.withColumn("_before", F.col("_base") + _running([*keys, "_b1"], "_b2"))
    else:  # brackets are narrow, so few fine parts have values
        fine = data.groupBy(*keys, "_b1", "_b2").agg(F.sum("_c").alias("_c"))
        fine = fine.withColumns({"_before": _running(keys, ["_b1", "_b2"]), "_n": F.sum("_c").over(Window.partitionBy(*keys))})
    fine = fine.where(holds()).select(*keys, "_b1", "_b2", "_n", F.col("_before").alias("_base"))

    values = joined(data, fine, [*keys, "_b1", "_b2"]).groupBy(*keys, "_b1", "_b2", "_base", "_n", "_v").agg(F.sum("_c").alias("_c"))
    values = values.withColumn("_before", F.col("_base") + _running([*keys, "_b1", "_b2"], "_v"))

    def at(c: str, rank: Column) -> Column:
        inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
        return F.max(F.when((F.col("_var") == c) & inside, F.col("_v")))

    aggs = []
    for i, c in enumerate(cols):
        for j, p in enumerate(probs):
            low, high = ranks(p)
            aggs += [at(c, low).alias(f"_lo{i}_{j}"), at(c, high).alias(f"_hi{i}_{j}"),
                     F.max(F.when(F.col("_var") == c, (F.col("_n") - 1) * F.lit(p) - low)).alias(f"_f{i}_{j}")]
    wide = values.groupBy(*by).agg(*aggs)
    if by:  # groups whose values are all missing still get their row
        cond = None
        for k in by:
            one = F.col(f"g.{k}").eqNullSafe(F.col(f"w.{k}"))
            cond = one if cond is None else cond & one
        groups = df.select(*by).distinct().alias("g")
        wide = groups.join(wide.alias("w"), cond, "left").select(
            *[F.col(f"g.{k}") for k in by], *[F.col(f"w.{c}") for c in wide.columns if c not in by])
    out = []
    for i, c in enumerate(cols):
        lo, hi, f = ([F.col(f"_{x}{i}_{j}") for j in range(len(probs))] for x in ("lo", "hi", "f"))
        # equal ends need no arithmetic, which infinities would not survive
        parts = [F.when((a == b) | (t == 0), a).otherwise(a + (b - a) * t) for a, b, t in zip(lo, hi, f)]
        out.append(F.when(lo[0].isNotNull(), F.array(*parts)).alias(c))
    return wide.select(*by, *out)


def percentile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> Column:
    """Global percentiles as a scalar struct: ``row[col][i]`` is the i-th prob."""
    return as_scalar(percentiles(df, cols, probs))


def value_ranks(df: DataFrame, var: str) -> DataFrame:
    """Distinct values ``v`` with their count ``c`` and the number ``start`` of smaller rows.

    Equal values are counted before the shuffle.  Ranks are sums over coarse buckets, over
    the fine ones inside a coarse one, and over the values inside a fine one.
    """
    counts = df.where(F.col(var).isNotNull()).groupBy(F.col(var).cast("double").alias("v")).agg(F.count("*").alias("c"))
    b1, b2 = _buckets(F.col("v"))
    placed = counts.withColumns({"_b1": b1, "_b2": b2})
    fine = placed.groupBy("_b1", "_b2").agg(F.sum("c").alias("c"))
    coarse = fine.groupBy("_b1").agg(F.sum("c").alias("c"))  # as many rows as coarse buckets, which the range of doubles bounds
    coarse = coarse.select("_b1", _running([], "_b1", "c").alias("_s1"))
    fine = fine.select("_b1", "_b2", _running(["_b1"], "_b2", "c").alias("_s2")).join(coarse, "_b1")
    inner = _running(["_b1", "_b2"], "v", "c")
    return placed.join(fine, ["_b1", "_b2"]).select(
        "v", "c", (F.col("_s1") + F.col("_s2") + inner).alias("start"))
