"""Mixing sources to target weights by whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import staged, words

#: Up to this many sources the table of targets is broadcast (below 10 MB); beyond it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def shares(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources: ``(source, source_size)`` to ``(source, source_size, target)``.

    Sources in code-point order, a missing one last, weigh ``weights`` in turn and divide ``share``
    times all sizes.  No target exceeds ``cap`` times its source; what is above goes to the others
    by weight.  The end of that resharing is found in one step: in order of size per weight the full
    sources come first, and a source is full if the level reached by the rest would exceed its cap.
    The table has one row per source, which is why its windows need no partition.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(int(w)) for w in weights])
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = (F.sum("source_size").over(every) * F.lit(float(share))
            - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    open_ = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    placed = (sizes.withColumn("_w", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
              .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
              .withColumn("_rest", rest).withColumn("_open", open_)
              .withColumn("_full", F.col("_cap") * F.col("_open") <= F.col("_w") * F.col("_rest")))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rest"), F.col("_open")))).over(every)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(
        F.least("_cap", F.col("_w") * (F.col("_level")["_rest"] / F.col("_level")["_open"])))
    return placed.withColumn("_level", level).select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                seed: str = "mix", size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``size`` defaults to the number of words; a missing text has none.  A source of size zero has
    target zero and no copies.  A document gets ``floor(rate)`` copies and one more if its hash falls
    below the fraction of the rate, where rate is target over size of its source.  The hash covers id
    and text, so reruns agree and repeated rows decide alike.  Own columns of these names are replaced.
    An empty table stays empty.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.withColumn("size", (F.size(words("text")).cast("long") if size is None else size))
    table = staged(shares(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "shares")
    side = table.select(F.col("source").alias("_source"), "source_size", "target")
    if table.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_rate", rate)
            .withColumn("_cut", ((F.col("_rate") - F.floor("_rate")) * F.lit(float(1 << 52))).cast("long"))
            .withColumn("copies", F.floor("_rate") + F.when(
                _draw(seed) < F.lower(F.lpad(F.hex("_cut"), 13, "0")), 1).otherwise(0))
            .drop("_rate", "_cut"))


def _draw(seed: str) -> Column:
    """52 bits as hex digits that compare like numbers."""
    own = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                   F.coalesce(F.md5("text"), F.lit("")))
    return F.substring(F.md5(own), 1, 13)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with ``docs``'s own columns and ``copy`` from 1."""
    own = [c for c in docs.columns if c != "copy"]
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in own]).alias("_row"))
    return (with_copies(packed, weights, share, cap, seed).where("copies > 0")
            .select("_row.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")))
