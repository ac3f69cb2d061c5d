"""Hyperparameter search: few fits, whose first trees or rounds stand for the smaller models; every fit and fold is a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.draws import draw, draw_cuts
from gridspark.functions.frames import COORDS, as_scalar, shared_folder
from gridspark.operators.boosting import gradients, softmax
from gridspark.operators.forests import bin_edges, packed, statistics
from gridspark.operators.sampling import folds
from gridspark.operators.trees import Growth, bag, grow

#: The searched values: fixed.
FOREST_GRID = {"trees": (50, 100, 200), "max_depth": (5, 10, 15), "min_split": (2, 5, 10)}
BOOSTED_GRID = {"rounds": (50, 100, 200), "max_depth": (3, 6, 9), "rate": (0.01, 0.1, 0.3)}
CHUNK = 25      # trees a task grows


def _scores(votes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over folds of the weighted F1 of rows ``by.., fold, actual, predicted, n``."""
    key = [*by, "fold"]
    none = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(none)
    side = lambda who, support, said: F.struct(F.col(who).alias("class"), support.alias("support"), said.alias("said"), hit.alias("hit"))
    sides = votes.select(*key, F.explode(F.array(side("actual", F.col("n"), none), side("predicted", none, F.col("n")))).alias("s")).select(*key, "s.*")
    per = sides.groupBy(*key, "class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("said")), F.lit(0.0))
    one = per.groupBy(*key).agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))
    return one.groupBy(*by).agg(F.avg("f1").alias("f1"), F.stddev_pop("f1").alias("f1_std"))


def _sample(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], k: int, max_rows: int, bins: int, seed: int):
    """At most ``max_rows`` labelled rows drawn by a hash, with folds, as arrays: fold, key, bins, class."""
    known = df.where(F.col(label).isNotNull())
    cut = as_scalar(draw_cuts(known, seed, keys, {"cut": F.least(F.col("n"), F.lit(max_rows))}))
    known = known.where(draw(seed, keys) <= F.coalesce(cut["cut"], F.lit("")))
    path = shared_folder(df.sparkSession, "search-rows")
    folded = folds(known.select(*keys, *[c for c in dict.fromkeys([*features, label]) if c not in keys]), keys, k, label, seed)
    folded.write.parquet(path)
    known = df.sparkSession.read.schema(folded.schema).parquet(path)
    rows = packed(known, features, bin_edges(known, features, bins), keys, F.col(label), F.col("fold"))
    few = rows.select("key", "x", "y", "w").orderBy("key", "x").toPandas()  # max_rows rows of a byte per feature
    x = np.frombuffer(b"".join(few.x), dtype=np.uint8).reshape(len(few), len(features))
    return few.w.to_numpy(np.int64), few.key.to_numpy(), x, few.y.to_numpy(np.int64)


def search_forest(df: DataFrame, features: Sequence[str], label: str = "label", keys: Sequence[str] = COORDS, grid: dict[str, Sequence] | None = None,
                  classes: int = 3, k: int = 3, max_rows: int = 50_000, bins: int = 32, seed: int = 42) -> DataFrame:
    """Weighted F1 of every combination of ``trees``, ``max_depth`` and ``min_split`` over ``k`` folds, best first: those names, ``f1, f1_std``.

    Tree t of a setting is the same in every forest that has it, so a forest of the largest size is grown once per setting and
    fold, and the smaller sizes are its first trees: their votes are cumulated.  A task grows
    ``CHUNK`` trees on the sample of at most ``max_rows`` rows, which all tasks hold.
    """
    grid = grid or FOREST_GRID
    spark, sizes = df.sparkSession, sorted(grid["trees"])
    fold, key, x, y = _sample(df, features, label, keys, k, max_rows, bins, seed)
    data = spark.sparkContext.broadcast((fold, key, x, y))  # bounded by max_rows
    bounds = sorted({*range(0, sizes[-1], CHUNK), *sizes, 0})
    work = [(d, float(m), f, a, b) for d, m, f, (a, b) in product(grid["max_depth"], grid["min_split"], range(k), zip(bounds[:-1], bounds[1:]))]
    subset = max(1, int(np.sqrt(len(features))))
    tasks = spark.createDataFrame(work, "max_depth int, min_split double, fold int, first int, upto int")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fold, key, x, y = data.value
        for batch in batches:
            for task in batch.to_pylist():
                train, test = np.flatnonzero(fold != task["fold"]), np.flatnonzero(fold == task["fold"])
                growth = Growth("class", bins, task["max_depth"], task["min_split"], 1, subset, seed=seed)
                votes = np.zeros((len(test), classes))
                for t in range(task["first"], task["upto"]):
                    times = bag(key[train], t, seed)
                    rows = train[times > 0]
                    if len(rows):
                        made, _ = grow(x[rows], statistics(y[rows], times[times > 0].astype(float), "class", classes), growth, t << 32)
                        votes += made.value[made.leaves(x[test])]
                n = len(test)
                yield pa.RecordBatch.from_pydict({
                    "max_depth": pa.array([task["max_depth"]] * n, pa.int32()), "min_split": pa.array([task["min_split"]] * n), "fold": pa.array([task["fold"]] * n, pa.int32()),
                    "upto": pa.array([task["upto"]] * n, pa.int32()), "row": pa.array(test), "actual": pa.array(y[test], pa.int32()), "votes": pa.array(list(votes), pa.list_(pa.float64()))})

    kind = "max_depth int, min_split double, fold int, upto int, row long, actual int, votes array<double>"
    found = tasks.repartition(len(work), "max_depth", "min_split", "fold", "first").mapInArrow(run, kind)
    path = shared_folder(spark, "search-votes")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    prefix = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("trees")
    each = found.select("*", prefix).where(F.col("upto") <= F.col("trees"))
    by = ["trees", "max_depth", "min_split"]
    total = each.groupBy(*by, "fold", "row", "actual").agg(*[F.sum(F.col("votes")[c]).alias(f"v{c}") for c in range(classes)])
    all_votes = F.array(*[F.round(f"v{c}", 9) for c in range(classes)])  # sums do not depend on their order
    said = total.groupBy(*by, "fold", "actual", (F.array_position(all_votes, F.array_max(all_votes)) - 1).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return _scores(said, by).orderBy(F.desc("f1"), *by)


def search_boosted(df: DataFrame, features: Sequence[str], label: str = "label", keys: Sequence[str] = COORDS, grid: dict[str, Sequence] | None = None,
                   classes: int = 3, k: int = 3, max_rows: int = 50_000, bins: int = 32, seed: int = 42) -> DataFrame:
    """The same for softmax boosting: ``rounds``, ``max_depth`` and ``rate``.  A task boosts one setting on one fold and counts its hits at every number of rounds."""
    grid = grid or BOOSTED_GRID
    spark, sizes = df.sparkSession, sorted(grid["rounds"])
    fold, _, x, y = _sample(df, features, label, keys, k, max_rows, bins, seed)
    data = spark.sparkContext.broadcast((fold, x, y))  # bounded by max_rows
    # the deepest and so slowest first
    work = sorted(((d, float(r), f) for d, r, f in product(grid["max_depth"], grid["rate"], range(k))), reverse=True)
    tasks = spark.createDataFrame(work, "max_depth int, rate double, fold int")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fold, x, y = data.value
        for batch in batches:
            for task in batch.to_pylist():
                train, test = np.flatnonzero(fold != task["fold"]), np.flatnonzero(fold == task["fold"])
                growth = Growth("boost", bins, task["max_depth"], seed=seed)
                m, left = np.zeros((len(train), classes)), np.zeros((len(test), classes))
                for r in range(1, sizes[-1] + 1):
                    p = softmax(m)
                    for c in range(classes):
                        made, at = grow(x[train], gradients(p, y[train], c), growth)
                        m[:, c] += task["rate"] * made.value[at, 0]
                        left[:, c] += task["rate"] * made.value[made.leaves(x[test]), 0]
                    if r in sizes:
                        pair, n = np.unique(y[test] * classes + left.argmax(axis=1), return_counts=True)
                        yield pa.RecordBatch.from_pydict({
                            "rounds": pa.array([r] * len(n), pa.int32()), "max_depth": pa.array([task["max_depth"]] * len(n), pa.int32()),
                            "rate": pa.array([task["rate"]] * len(n)), "fold": pa.array([task["fold"]] * len(n), pa.int32()),
                            "actual": pa.array(pair // classes, pa.int32()), "predicted": pa.array(pair % classes, pa.int32()), "n": pa.array(n, pa.int64())})

    found = tasks.repartition(len(work), "max_depth", "rate", "fold").mapInArrow(
        run, "rounds int, max_depth int, rate double, fold int, actual int, predicted int, n long")
    path = shared_folder(spark, "search-hits")
    found.write.parquet(path)
    by = ["rounds", "max_depth", "rate"]
    return _scores(spark.read.schema(found.schema).parquet(path), by).orderBy(F.desc("f1"), *by)
