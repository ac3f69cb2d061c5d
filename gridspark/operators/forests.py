"""Random forests without a depth limit: top levels grown over all rows, subtrees finished inside tasks, trees kept as a table of nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS, shared_folder
from gridspark.operators.trees import Growth, Nodes, bag, best_splits, binned, grow, histograms, mixed

NODE = "tree int, id long, feature int, cut int, left long, right long, value array<double>, weight double, gain double"
TOP_NODES = 1 << 13     # most nodes above the subtrees of a tree
LOCAL = 32              # bits of a node's id within its subtree
PACK = 1 << 18          # nodes scored together
CELLS_AT_ONCE = 1 << 18     # histogram cells of one job
Tops = dict[int, Nodes]


class Split(NamedTuple):
    """A node's best split: ``feature`` -1 for none; statistics of all its rows and of those that go left, and numbers of rows."""

    slot: int
    feature: int
    cut: int
    gain: float
    total: np.ndarray
    low: np.ndarray
    low_rows: float
    high_rows: float


@dataclass
class Forest:
    """``nodes`` is the forest; ``tops`` holds the levels above the subtrees (none for small inputs, at most ``TOP_NODES`` nodes a tree)."""

    nodes: DataFrame
    tops: Tops
    features: list[str]
    edges: list[np.ndarray]
    growth: Growth
    trees: int
    classes: int
    keys: list[str]

    @property
    def width(self) -> int:
        return self.classes if self.growth.kind == "class" else 1


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[np.ndarray]:
    """Up to ``bins - 1`` cut points per feature, near its quantiles, from one aggregate."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], dtype=np.float64)) for q in row]


def _row_key(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def packed(df: DataFrame, features: Sequence[str], edges: Sequence[np.ndarray], keys: Sequence[str], target: Column | None = None,
           weight: Column | None = None) -> DataFrame:
    """Rows as ``row`` (the keys), ``key`` (their hash), ``x`` (a byte per feature), and target ``y`` and weight ``w`` if asked for."""
    own = [F.struct(*keys).alias("row"), _row_key(keys).alias("key")]
    own += [target.cast("double").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")] if target is not None else []
    names = [f"f{i}" for i in range(len(features))]
    rows = df.select(*own, *[F.col(f).cast("double").alias(n) for n, f in zip(names, features)])
    kind = rows.schema["row"].dataType.simpleString()
    more = ", y double, w double" if target is not None else ""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = binned([batch.column(n).to_numpy(zero_copy_only=False) for n in names], edges)
            cells = pa.array([r.tobytes() for r in x], pa.binary())
            cols = {"row": batch.column("row"), "key": batch.column("key"), "x": cells}
            yield pa.RecordBatch.from_pydict(cols | ({c: batch.column(c) for c in "yw"} if more else {}))

    return rows.mapInArrow(run, f"row {kind}, key long, x binary{more}")


def statistics(y: np.ndarray, w: np.ndarray, kind: str, classes: int) -> np.ndarray:
    if kind == "class":
        return np.eye(classes)[y.astype(np.int64)] * w[:, None]
    return np.stack([w, w * y], axis=1)


def unpacked(column, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, features)


def level_splits(rows: DataFrame, visit, growth: Growth, features: int, stats: int, slots: int) -> list[Split]:
    """Splits of one level over all rows, one per slot that has rows.

    ``visit(batch)`` gives ``(slots, slot numbers, x, statistics)`` pieces of a batch.  Tasks send one row per filled cell of their
    histograms and Spark adds them up.  The driver reads the sums, ``slots`` x features x bins at most; callers bound that by ``CELLS_AT_ONCE``.
    """
    bins, cols = growth.bins, [f"s{i}" for i in range(stats + 1)]
    if slots * features * bins > max(CELLS_AT_ONCE, features * bins):
        raise ValueError("too many nodes for one job")

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for numbers, slot, x, s in visit(batch):
                h = histograms(x, np.concatenate([s, np.ones((len(s), 1))], axis=1), slot, len(numbers), bins)
                for i, number in enumerate(numbers):
                    held[number] = held[number] + h[i] if number in held else h[i]
        for number, h in held.items():
            flat = h.reshape(-1, stats + 1)
            hit = np.flatnonzero(flat[:, -1])
            yield pa.RecordBatch.from_pydict({"slot": pa.array(np.full(len(hit), number), pa.int64()), "cell": pa.array(hit, pa.int32()),
                                              **{c: pa.array(flat[hit, i]) for i, c in enumerate(cols)}})

    found = rows.mapInArrow(sums, "slot long, cell int, " + ", ".join(f"{c} double" for c in cols))
    added = found.groupBy("slot", "cell").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    numbers, slot = np.unique(added.slot.to_numpy(), return_inverse=True)
    h = np.zeros((len(numbers) * features * bins, stats + 1))
    h[slot * features * bins + added.cell.to_numpy()] = added[cols].to_numpy()
    h = h.reshape(len(numbers), features, bins, stats + 1)
    feature, cut, gain = best_splits(h[..., :-1], growth, numbers)
    total = h[:, 0].sum(axis=1)
    return [Split(int(n), int(f), int(c), float(g), t[:-1], low[:-1], low[-1], t[-1] - low[-1]) for i, (n, f, c, g, t) in enumerate(
        zip(numbers, feature, cut, gain, total)) for low in [h[i, max(f, 0), :c + 1].sum(axis=0)]]


def _route(tops: Tops, tree: int, x: np.ndarray) -> np.ndarray:
    """The node of ``tops`` where rows leave the top of a tree."""
    return tops[tree].leaves(x) if tree in tops else np.zeros(len(x), dtype=np.int64)


def _grow_tops(rows: DataFrame, n: int, growth: Growth, forest: Forest, node_rows: int) -> tuple[Tops, dict[tuple[int, int], int]]:
    """Levels over all rows until every node has at most ``node_rows`` rows; also the depth of each open node."""
    features, width = len(forest.features), (forest.classes if growth.kind == "class" else 2)
    seed, kind, classes = growth.seed, growth.kind, forest.classes
    made: dict[int, list[list]] = {}
    todo = [(t, 0, 0) for t in range(forest.trees)] if n > node_rows else []
    depths: dict[tuple[int, int], int] = {(t, 0): 0 for t in range(forest.trees)}
    if todo:
        made = {t: [[-1, 0, -1, -1, None, 0.0, 0.0]] for t in range(forest.trees)}
    most = max(1, CELLS_AT_ONCE // (features * growth.bins))
    while todo:
        now, todo = todo[:most], todo[most:]
        tops = {t: _as_nodes(made[t]) for t in {t for t, _, _ in now}}
        open_ = {t: np.array(sorted(node for u, node, _ in now if u == t)) for t in tops}

        def visit(batch, tops=tops, open_=open_):
            x, key, y, w = unpacked(batch.column("x"), features), *[batch.column(c).to_numpy() for c in ("key", "y", "w")]
            for t, nodes in open_.items():
                times = bag(key, t, seed)
                at = tops[t].leaves(x)
                hit = np.flatnonzero((times > 0) & np.isin(at, nodes))
                if len(hit):
                    s = statistics(y[hit], w[hit] * times[hit], kind, classes)
                    yield [(t << 32) + int(m) for m in nodes], np.searchsorted(nodes, at[hit]), x[hit], s

        depth_of = {(t, m): d for t, m, d in now}
        for r in level_splits(rows, visit, growth, features, width, len(now)):
            t, m = r.slot >> 32, r.slot & ((1 << 32) - 1)
            if r.feature < 0 or (growth.depth is not None and depth_of[t, m] >= growth.depth):
                continue
            size = len(made[t])
            total = r.total[None]
            made[t][m] = [r.feature, r.cut, size, size + 1, growth.value(total)[0].tolist(), float(growth.weight(total)[0]), r.gain]
            made[t] += [[-1, 0, -1, -1, None, 0.0, 0.0], [-1, 0, -1, -1, None, 0.0, 0.0]]
            del depths[t, m]
            for child, count in ((size, r.low_rows), (size + 1, r.high_rows)):
                depths[t, child] = depth_of[t, m] + 1
                if count > node_rows and len(made[t]) < TOP_NODES:
                    todo.append((t, child, depth_of[t, m] + 1))
    return {t: _as_nodes(m) for t, m in made.items() if len(m) > 1}, depths


def _as_nodes(made: list[list]) -> Nodes:
    cols = list(zip(*made))
    return Nodes(*[np.array(c, dtype=np.int64) for c in cols[:4]], np.zeros((len(made), 0)), np.array(cols[5]), np.array(cols[6]))


def fit_forest(df: DataFrame, features: Sequence[str], target: str, kind: str = "class", keys: Sequence[str] = COORDS, trees: int = 100,
               classes: int = 3, depth: int | None = None, min_split: float = 2, min_leaf: float = 1, subset: int | None = None, bins: int = 64,
               seed: int = 42, node_rows: int = 50_000, weight: str | None = None) -> Forest:
    """Grow a forest for labels 0 to ``classes - 1`` (``class``) or a numeric target (``number``); ``keys`` identify a row.

    Rows without a target are left out; a missing feature counts as its smallest value.  Bags are Poisson draws from a hash of row
    key and tree.  While a node has more than ``node_rows`` rows it is split over all rows, for many trees and nodes in one
    job; then its rows meet in one task, which finishes the subtree to whatever depth it takes.  So a task holds at most
    ``node_rows`` rows of a tree, unless equal rows cannot be split further or a tree's top has ``TOP_NODES`` nodes.
    """
    growth = Growth(kind, bins, depth, min_split, min_leaf, subset, seed=seed)
    known = df.where(F.col(target).isNotNull())
    edges = bin_edges(known, features, bins)
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "forest-rows")
    rows = packed(known, features, edges, keys, F.col(target), F.col(weight) if weight else None).drop("row")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    forest = Forest(rows, {}, list(features), edges, growth, trees, classes, list(keys))
    tops, depths = _grow_tops(rows, rows.count(), growth, forest, node_rows)
    count = len(features)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, key = unpacked(batch.column("x"), count), batch.column("key").to_numpy()
            for t in range(trees):
                times = bag(key, t, seed)
                hit = np.flatnonzero(times)
                part = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array(np.full(len(hit), t), pa.int32()), "node": pa.array(_route(tops, t, x[hit]), pa.int64()),
                    "x": part.column("x"), "y": part.column("y"), "w": pa.array(part.column("w").to_numpy() * times[hit], pa.float64())})

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        t, node = int(part.tree.iloc[0]), int(part.node.iloc[0])
        part = part.sort_values(["x", "y", "w"], kind="stable")  # sums do not depend on the order of arrival
        x = np.frombuffer(b"".join(part.x), dtype=np.uint8).reshape(-1, count)
        made, _ = grow(x, statistics(part.y.to_numpy(), part.w.to_numpy(), kind, classes), growth, int(mixed(np.array([(t << 32) + node]))[0] >> np.uint64(8)),
                       depths.get((t, node), 0))
        base = node << LOCAL
        link = lambda c: np.where(c >= 0, c + base, -1)
        return pd.DataFrame({"tree": t, "id": base + np.arange(len(made.feature)), "feature": made.feature, "cut": made.cut, "left": link(made.left),
                             "right": link(made.right), "value": list(made.value), "weight": made.weight, "gain": made.gain})

    dealt = rows.mapInArrow(deal, "tree int, node long, x binary, y double, w double")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # several groups of unequal size per core
    made = dealt.repartition(parts, "tree", "node").groupBy("tree", "node").applyInPandas(finish, NODE)
    upper = [(t, int(i) << LOCAL, int(f), int(c), int(a) << LOCAL, int(b) << LOCAL, [], float(w), float(g)) for t, top in tops.items()
             for i, (f, c, a, b, w, g) in enumerate(zip(top.feature, top.cut, top.left, top.right, top.weight, top.gain)) if f >= 0]
    path = shared_folder(spark, "forest-nodes")
    made.write.parquet(path)
    nodes = spark.read.schema(made.schema).parquet(path)
    if upper:
        nodes = nodes.unionByName(spark.createDataFrame(upper, NODE))
    forest.nodes, forest.tops = nodes, tops
    return forest


def _pack(part: pd.DataFrame, width: int) -> bytes:
    """Subtrees as one buffer: number of roots, their (tree, node) and places, then the columns of all nodes."""
    part = part.sort_values(["tree", "id"], kind="stable")
    tree, ids = part.tree.to_numpy(np.int64), part.id.to_numpy(np.int64)
    root = np.flatnonzero(ids & ((1 << LOCAL) - 1) == 0)
    start = np.repeat(root, np.diff(np.append(root, len(ids))))
    inner = part.feature.to_numpy() >= 0
    local = lambda c: np.where(inner, (part[c].to_numpy(np.int64) & ((1 << LOCAL) - 1)) + start, 0)
    value = np.stack([np.asarray(v, dtype=np.float64) for v in part.value]).reshape(len(ids), width)
    head = np.array([len(root), len(ids), width], dtype=np.int64)
    return b"".join(a.tobytes() for a in (head, tree[root], ids[root] >> LOCAL, root.astype(np.int64), part.feature.to_numpy(np.int64),
                                          part.cut.to_numpy(np.int64), local("left"), local("right"), value))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Nodes]:
    roots, n, width = np.frombuffer(blob, dtype=np.int64, count=3).tolist()
    ints = np.frombuffer(blob, dtype=np.int64, count=3 * roots + 4 * n, offset=24)
    cut = np.cumsum([roots] * 3 + [n] * 4)[:-1]
    tree, node, place, feature, level, left, right = np.split(ints, cut)
    value = np.frombuffer(blob, dtype=np.float64, offset=24 + 8 * len(ints)).reshape(n, width)
    return tree, node, place, Nodes(feature, level, left, right, value, np.zeros(0), np.zeros(0))


def votes(forest: Forest, df: DataFrame, left_out: bool = False) -> DataFrame:
    """Per row of ``df`` (its keys): ``n`` trees that voted, and sums ``v0..`` of their leaf values and ``q0..`` of the squares.

    With ``left_out`` only trees whose bag does not hold the row vote.  Subtrees are packed into parcels of about ``PACK`` nodes; rows
    and parcels meet by parcel and a salt, the parcel first, and sums of a row are folded by its keys.  So
    nothing is broadcast, and a forest of any size is scored.
    """
    spark, width, tops, seed = df.sparkSession, forest.width, forest.tops, forest.growth.seed
    count, trees = len(forest.features), forest.trees
    own = F.expr(f"shiftright(id, {LOCAL})").alias("node")
    inside = forest.nodes.where(F.size("value") > 0).withColumn("node", own)
    sizes = inside.groupBy("tree", "node").agg(F.count("*").alias("n")).orderBy("tree", "node").collect()  # at most TOP_NODES a tree
    parcel, filled = {}, 0
    for r in sizes:
        parcel[r["tree"], r["node"]] = filled // PACK
        filled += r["n"]
    parcels = filled // PACK + 1
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.createDataFrame([(t, m, p) for (t, m), p in parcel.items()], "tree int, node long, parcel int")
    blobs = inside.join(numbers, ["tree", "node"]).groupBy("parcel").applyInPandas(
        lambda key, part: pd.DataFrame({"parcel": [key[0]], "blob": [_pack(part, width)]}), "parcel int, blob binary")
    rows = packed(df, forest.features, forest.edges, forest.keys)
    row_kind = rows.schema["row"].dataType.simpleString()
    # rows go to each parcel that holds a subtree they reach; without tops that is every one
    if tops:
        def reach(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                x = unpacked(batch.column("x"), count)
                hit = np.zeros((len(x), parcels), dtype=bool)
                for t in range(trees):
                    at, back = np.unique(_route(tops, t, x), return_inverse=True)
                    hit[np.arange(len(x)), np.array([parcel[t, int(a)] for a in at])[back]] = True
                r, p = np.nonzero(hit)
                part = batch.take(pa.array(r))
                yield pa.RecordBatch.from_pydict({"parcel": pa.array(p, pa.int32()), **{c: part.column(c) for c in ("row", "key", "x")}})

        sent = rows.mapInArrow(reach, f"parcel int, row {row_kind}, key long, x binary")
    else:
        sent = rows.withColumn("parcel", F.explode(F.sequence(F.lit(0), F.lit(parcels - 1))))
    sent = sent.withColumn("salt", F.pmod("key", F.lit(deal)).cast("int"))
    ahead = blobs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    both = ahead.unionByName(sent, allowMissingColumns=True).repartition(deal, "parcel", "salt")
    both = both.sortWithinPartitions("parcel", "salt", F.col("blob").isNull())
    sums = [f"{c}{i}" for c in "vq" for i in range(width)]

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            empty = batch.column("blob").is_null().to_numpy(zero_copy_only=False)
            cuts = sorted({0, *np.flatnonzero(~empty).tolist(), len(empty)})
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s < len(empty) and not empty[s]:
                    held, s = _unpack(batch.column("blob")[s].as_py()), s + 1
                if s >= e:
                    continue
                part = batch.slice(s, e - s)
                x, key = unpacked(part.column("x"), count), part.column("key").to_numpy()
                tree, node, place, nodes = held
                v, q, n = np.zeros((len(x), width)), np.zeros((len(x), width)), np.zeros(len(x), dtype=np.int64)
                for t in np.unique(tree).tolist():
                    mine = np.flatnonzero(tree == t)
                    at = np.searchsorted(node[mine], reached := _route(tops, t, x))
                    at = np.minimum(at, len(mine) - 1)
                    hit = node[mine][at] == reached
                    if left_out:
                        hit &= bag(key, t, seed) == 0
                    hit = np.flatnonzero(hit)
                    got = nodes.value[nodes.leaves(x[hit], place[mine][at[hit]])]
                    v[hit] += got
                    q[hit] += got * got
                    n[hit] += 1
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "n": pa.array(n), **{
                    c: pa.array(a[:, i]) for a, k in ((v, "v"), (q, "q")) for i in range(width) for c in [f"{k}{i}"]}})

    out = both.mapInArrow(score, f"row {row_kind}, n long, " + ", ".join(f"{c} double" for c in sums))
    return out.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).select("row.*", "n", *sums)


def predict(forest: Forest, df: DataFrame, left_out: bool = False) -> DataFrame:
    """``df`` with ``prediction``, and ``probabilities`` (classes) or ``uncertainty``, the population deviation of the trees (numbers).

    Rows no tree votes for, which only ``left_out`` can leave, get NULL.
    """
    v = votes(forest, df, left_out)
    n = F.when(F.col("n") > 0, F.col("n"))
    if forest.growth.kind == "class":
        shares = F.when(F.col("n") > 0, F.array(*[F.col(f"v{i}") / n for i in range(forest.width)]))
        out = [(F.array_position(shares, F.array_max(shares)) - 1).cast("double").alias("prediction"), shares.alias("probabilities")]
    else:
        mean = F.col("v0") / n
        out = [mean.alias("prediction"), F.sqrt(F.greatest(F.col("q0") / n - mean * mean, F.lit(0.0))).alias("uncertainty")]
    found = v.select(*forest.keys, *out)
    return df.join(found, forest.keys)


def out_of_bag(forest: Forest, df: DataFrame, target: str) -> DataFrame:
    """``rows`` of the training rows some tree left out, and their ``accuracy`` (classes) or ``r2`` (numbers) by those trees alone."""
    scored = predict(forest, df.where(F.col(target).isNotNull()), left_out=True).where(F.col("prediction").isNotNull())
    y, p = F.col(target).cast("double"), F.col("prediction")
    if forest.growth.kind == "class":
        return scored.agg(F.count("*").alias("rows"), F.avg((y == p).cast("double")).alias("accuracy"))
    return scored.agg(F.count("*").alias("rows"), (1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"))


def importance(forest: Forest, k: int = 10) -> DataFrame:
    """The ``k`` features whose splits gain most, as shares of all gains, weighed equally over trees."""
    spark = forest.nodes.sparkSession
    names = spark.createDataFrame(list(enumerate(forest.features)), "feature int, name string")
    gains = forest.nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    total = gains.groupBy("tree").agg(F.sum("g").alias("all"))
    share = gains.join(total, "tree").groupBy("feature").agg((F.sum(F.col("g") / F.col("all"))).alias("s"))
    norm = share.agg(F.sum("s")).scalar()
    rest = names.join(share, "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("s") / norm, F.lit(0.0)).alias("importance"))
    return rest.orderBy(F.desc("importance"), "feature").limit(k)
