"""Softmax boosting: one tree per class and round, all classes grown from one histogram job per level."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import shared_folder
from gridspark.operators.forests import CELLS_AT_ONCE, bin_edges, level_splits, packed, unpacked
from gridspark.operators.trees import Growth, Nodes, binned, grow

GROWN = "k int, node long, at long, feature int, cut int, left long, right long, value double, weight double, gain double"
STAGE = 20      # rounds whose trees are applied anew by each job, before margins are written


@dataclass
class Boosted:
    """Rounds of trees, one per class.  The depth bounds their size: at most 2^(depth + 1) nodes a tree."""

    features: list[str]
    edges: list[np.ndarray]
    rate: float
    classes: int
    rounds: list[list[Nodes]] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return predict(self, df)


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Rows, gradient and hessian of the log-loss in the margin of class ``k``."""
    return np.stack([np.ones(len(y)), p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-16)], axis=1)


def margins(rounds: Sequence[Sequence[Nodes]], x: np.ndarray, rate: float, start: np.ndarray) -> np.ndarray:
    m = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            m[:, k] += rate * tree.value[tree.leaves(x), 0]
    return m


def fit_boosted(df: DataFrame, features: Sequence[str], label: str = "label", classes: int = 3, rounds: int = 100,
                depth: int = 5, rate: float = 0.1, ridge: float = 1.0, min_leaf: float = 1, bins: int = 64, seed: int = 42, node_rows: int = 50_000) -> Boosted:
    """Fit on all rows with a label from 0 to ``classes - 1``; a missing feature counts as its smallest value.

    A node with more than ``node_rows`` rows is split over all rows: a level of a round's trees is one job over all rows (several, where its classes x nodes x features x bins cells are more than
    ``CELLS_AT_ONCE``).  The rows of a smaller node meet in one task, which grows what is left below it; one job does so for all such nodes of
    a round.  Margins are written to the shared folder every ``STAGE`` rounds.
    """
    growth = Growth("boost", bins, depth, 2, min_leaf, ridge=ridge, seed=seed)
    spark, known = df.sparkSession, df.where(F.col(label).isNotNull())
    model = Boosted(list(features), bin_edges(known, features, bins), rate, classes)
    count = len(features)
    rows = packed(known, features, model.edges, features[:1], F.col(label)).select("x", "y", F.array(*[F.lit(0.0)] * classes).alias("m"))

    def written(rows: DataFrame) -> DataFrame:
        path = shared_folder(spark, "boosted-rows")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def read(batch, recent: Sequence[Sequence[Nodes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = unpacked(batch.column("x"), count), batch.column("y").to_numpy()
        start = batch.column("m").flatten().to_numpy().reshape(len(x), classes)
        return x, y, margins(recent, x, rate, start)

    def visit(partial, open_, recent, batch):
        x, y, m = read(batch, recent)
        p = softmax(m)
        for k in range(classes):
            at = partial[k].leaves(x)
            hit = np.flatnonzero(np.isin(at, open_[k]))
            if len(hit):
                yield [(k << 32) + int(n) for n in open_[k]], np.searchsorted(open_[k], at[hit]), x[hit], gradients(p[hit], y[hit], k)

    def deal(partial, small, recent, batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y, m = read(batch, recent)
            p = softmax(m)
            for k in range(classes):
                at = partial[k].leaves(x)
                hit = np.flatnonzero(np.isin(at, np.array([node for c, node in small if c == k], dtype=np.int64)))
                g = gradients(p[hit], y[hit], k)
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(hit), k), pa.int32()), "node": pa.array(at[hit]), "x": batch.column("x").take(pa.array(hit)),
                                                  "g": pa.array(g[:, 1]), "h": pa.array(g[:, 2])})

    def finish(small, part: pd.DataFrame) -> pd.DataFrame:
        k, node = int(part.k.iloc[0]), int(part.node.iloc[0])
        part = part.sort_values(["x", "g"], kind="stable")  # sums do not depend on the order of arrival
        x = np.frombuffer(b"".join(part.x), dtype=np.uint8).reshape(-1, count)
        made, _ = grow(x, np.stack([np.ones(len(x)), part.g, part.h], axis=1), growth, depth=small[k, node])
        return pd.DataFrame({"k": k, "node": node, "at": np.arange(len(made.feature)), "feature": made.feature, "cut": made.cut, "left": made.left,
                             "right": made.right, "value": made.value[:, 0], "weight": made.weight, "gain": made.gain})

    def grown(partial, small, recent) -> pd.DataFrame:
        dealt = rows.mapInArrow(functools.partial(deal, partial, small, recent), "k int, node long, x binary, g double, h double")
        return dealt.groupBy("k", "node").applyInPandas(lambda part: finish(small, part), GROWN).toPandas()  # at most 2^(depth + 1) nodes per class

    rows, recent = written(rows), []
    size_of_all = rows.count()
    for number in range(rounds):
        made = [[[-1, 0, -1, -1, 0.0, 0.0, 0.0]] for _ in range(classes)]
        roots = [(k, 0) for k in range(classes)]
        todo, small = (roots, {}) if size_of_all > node_rows else ([], {r: 0 for r in roots})
        for level in range(depth):
            if not todo:
                break
            partial = [_nodes(m) for m in made]
            most, splits = max(1, CELLS_AT_ONCE // (count * bins)), []
            for s in range(0, len(todo), most):
                part = set(todo[s:s + most])
                open_ = [np.array(sorted(node for c, node in part if c == k), dtype=np.int64) for k in range(classes)]
                splits += level_splits(rows, functools.partial(visit, partial, open_, recent), growth, count, 3, len(part))
            todo = []
            for r in splits:
                k, node = r.slot >> 32, r.slot & ((1 << 32) - 1)
                total, low = r.total[None], r.low[None]
                if level == 0:
                    made[k][0][4] = float(growth.value(total)[0, 0])
                if r.feature < 0:
                    continue
                size = len(made[k])
                made[k][node][:4], made[k][node][6] = [r.feature, r.cut, size, size + 1], r.gain
                for child, side in ((size, low), (size + 1, total - low)):
                    made[k].append([-1, 0, -1, -1, float(growth.value(side)[0, 0]), float(side[0, 0]), 0.0])
                    if level + 1 < depth and side[0, 0] > node_rows:
                        todo.append((k, child))
                    elif level + 1 < depth:
                        small[k, child] = level + 1
        if small:
            _graft(made, grown([_nodes(m) for m in made], small, recent))
        recent = [*recent, [_nodes(m) for m in made]]
        model.rounds.append(recent[-1])
        if len(recent) == STAGE and number + 1 < rounds:
            def add(batches: Iterator, recent=recent) -> Iterator:
                import pyarrow as pa

                for batch in batches:
                    _, _, m = read(batch, recent)
                    yield pa.RecordBatch.from_pydict({"x": batch.column("x"), "y": batch.column("y"), "m": pa.array(list(m), pa.list_(pa.float64()))})

            rows, recent = written(rows.mapInArrow(add, "x binary, y double, m array<double>")), []
    return model


def _graft(made: list[list[list]], grown: pd.DataFrame) -> None:
    """Put subtrees in the place of the leaves they grew from."""
    for (k, node), part in grown.sort_values("at").groupby(["k", "node"]):
        base = len(made[k]) - 1
        link = lambda i: i + base if i > 0 else -1
        new = [[f, c, link(a), link(b), v, w, g] for f, c, a, b, v, w, g in part[["feature", "cut", "left", "right", "value", "weight", "gain"]].itertuples(index=False)]
        made[k][node] = new[0]
        made[k] += new[1:]


def _nodes(made: list[list]) -> Nodes:
    cols = list(zip(*made))
    return Nodes(*[np.array(c, dtype=np.int64) for c in cols[:4]], np.array(cols[4])[:, None], np.array(cols[5]), np.array(cols[6]))


def predict(model: Boosted, df: DataFrame, upto: int | None = None) -> DataFrame:
    """``df`` with ``prediction`` and ``probabilities`` of the first ``upto`` rounds (all by default)."""
    names, rounds = [f"f{i}" for i in range(len(model.features))], model.rounds[:upto]
    edges, rate, classes = model.edges, model.rate, model.classes

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = binned([batch.column(n).to_numpy(zero_copy_only=False) for n in names], edges)
            p = softmax(margins(rounds, x, rate, np.zeros((len(x), classes))))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "prediction": pa.array(p.argmax(axis=1).astype(np.float64)),
                                              "probabilities": pa.array(list(p), pa.list_(pa.float64()))})

    rows = df.select(F.struct(*df.columns).alias("row"), *[F.col(f).cast("double").alias(n) for n, f in zip(names, model.features)])
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, prediction double, probabilities array<double>").select("row.*", "prediction", "probabilities")


def log_loss(label: str = "label") -> Column:
    """Mean log-loss of rows scored by ``predict``, as a column for an aggregate."""
    p = F.get("probabilities", F.col(label).cast("int"))
    return F.avg(-F.log(F.greatest(p, F.lit(1e-15))))
