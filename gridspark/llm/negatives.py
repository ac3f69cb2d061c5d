"""Hard negatives of anchors, found exactly behind bounds from segment means and deviations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import partitions, staged

LARGEST = float(1 << 62)    # sums of squares from here on could leave the range of a LONG score
EXACT = float(1 << 53)      # below it doubles hold integer products exactly
DENSE = 0.2                 # share of a tile's pairs from which on the whole tile is multiplied
STRIP = 1 << 21             # pairs whose bounds are held at a time


class Summaries:
    """Rows of integer vectors with the mean and deviation of each segment, at several segment lengths, coarse to fine."""

    def __init__(self, vectors: np.ndarray, lengths: Sequence[int]):
        self.exact = vectors
        self.norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
        self.levels = []
        wide = vectors.astype(np.float64)
        for m in lengths:
            cuts = np.arange(0, wide.shape[1], m)
            sizes = np.diff(np.append(cuts, wide.shape[1]))
            mean = np.add.reduceat(wide, cuts, axis=1) / sizes
            # deviations from the mean itself, so that large means lose no digits
            dev = np.sqrt(np.add.reduceat((wide - np.repeat(mean, sizes, axis=1)) ** 2, cuts, axis=1) / sizes)
            self.levels.append((mean * np.sqrt(sizes), dev * np.sqrt(sizes)))


def bounds(a: Summaries, b: Summaries, level: int, i: np.ndarray | slice, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of rows ``i`` of ``a`` with all rows of ``b``, or with rows ``j`` one by one.

    Within a segment of m components the inner product is m times the product of the means, plus or minus at most m times the product of the deviations.
    The slack covers rounding.
    """
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    if j is None:
        mid, off = am[i] @ bm.T, ad[i] @ bd.T
    else:
        mid, off = np.einsum("ij,ij->i", am[i], bm[j]), np.einsum("ij,ij->i", ad[i], bd[j])
    slack = 1e-9 * a.norm * b.norm + 1e-6
    return mid - off - slack, mid + off + slack


def scores(a: Summaries, b: Summaries, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact integer inner products of pairs of rows."""
    kind = np.float64 if a.norm * b.norm < EXACT else np.int64
    return np.einsum("ij,ij->i", a.exact[i].astype(kind), b.exact[j].astype(kind)).astype(np.int64)


def tile_scores(a: Summaries, b: Summaries, i: slice) -> np.ndarray:
    """Exact integer inner products of rows ``i`` of ``a`` with all rows of ``b``."""
    kind = np.float64 if a.norm * b.norm < EXACT else np.int64
    return (a.exact[i].astype(kind) @ b.exact.astype(kind).T).astype(np.int64)


Limits = tuple[np.ndarray, np.ndarray]     # per anchor the least and the greatest wanted score


def best(a: Summaries, b: Summaries, windows: Sequence[Limits], k: int, allowed: Callable[[slice], np.ndarray] | None = None
         ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``anchor, window, rows, scores`` of the ``k`` rows of ``b`` with the highest scores inside each window of each anchor, ties by row.

    Level by level, coarse to fine: pairs whose bounds fall inside a window for sure give a score that ``k`` rows
    reach; pairs that cannot come up to it, or that touch no window, are dropped.  Only what is left is scored exactly.
    """
    step = max(1, STRIP // max(1, len(b.exact)))
    for s in range(0, len(a.exact), step):
        t = slice(s, min(s + step, len(a.exact)))
        own = [(lo[t], hi[t]) for lo, hi in windows]
        open_ = np.ones((t.stop - s, len(b.exact)), dtype=bool) if allowed is None else allowed(t)
        level = 0
        while level < len(a.levels) and (level == 0 or open_.mean() > DENSE):  # most pairs are left: bounds by products of whole tiles
            low, high = bounds(a, b, level, t)
            stay = np.zeros(open_.shape, dtype=bool)
            for lo, hi in own:
                inside = open_ & (low >= lo[:, None]) & (high <= hi[:, None])
                least = lo.astype(np.float64)
                for r in np.flatnonzero(inside.sum(axis=1) >= k):
                    least[r] = max(least[r], np.partition(low[r, inside[r]], -k)[-k])
                stay |= (high >= least[:, None]) & (low <= hi[:, None])
            open_ &= stay
            level += 1
        if open_.mean() > DENSE:
            i, j = np.nonzero(open_)
            exact = tile_scores(a, b, t)[i, j]
        else:
            i, j = np.nonzero(open_)
            for finer in range(level, len(a.levels)):
                low, high = bounds(a, b, finer, i + s, j)
                first = np.searchsorted(i, np.arange(t.stop - s + 1)).tolist()
                stay = np.zeros(len(i), dtype=bool)
                for lo, hi in own:
                    inside = (low >= lo[i]) & (high <= hi[i])
                    least = lo.astype(np.float64)
                    for r in np.flatnonzero(np.bincount(i[inside], minlength=t.stop - s) >= k):
                        x, y = first[r], first[r + 1]
                        least[r] = max(least[r], np.partition(low[x:y][inside[x:y]], -k)[-k])
                    stay |= (high >= least[i]) & (low <= hi[i])
                i, j = i[stay], j[stay]
            exact = scores(a, b, i + s, j)
        first = np.searchsorted(i, np.arange(t.stop - s + 1)).tolist()
        for r, (x, y) in enumerate(zip(first[:-1], first[1:])):
            order = np.argsort(-exact[x:y], kind="stable") + x
            ranked = exact[order]
            for w, (lo, hi) in enumerate(own):
                begin = int(np.searchsorted(-ranked, -hi[r]))
                end = min(int(np.searchsorted(-ranked, -lo[r], side="right")), begin + k)
                if begin < end:
                    yield r + s, w, j[order[begin:end]], ranked[begin:end]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, whole, tie, dim`` of the rows that take part; components become ``floor(256 * x)``.

    Rows whose id, label or vector is missing or empty, or holds a missing or non-finite component, take no part,
    nor do vectors so large that a score might not fit a LONG.  Rows equal in id, label and vector count once;
    rows that share only the id stay rows of their own, told apart by ``tie``.
    """
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
          & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                         F.when(F.coalesce(ok, F.lit(False)), F.transform("embedding", lambda x: x.cast("double"))).alias("e"))
    squares = F.aggregate("e", F.lit(0.0), lambda s, x: s + F.floor(256 * x).cast("double") * F.floor(256 * x).cast("double"))
    own = own.where(F.col("e").isNotNull()).where(squares < LARGEST)
    whole = own.select("vec_id", "label", F.transform("e", lambda x: F.floor(256 * x).cast("long")).alias("whole"))
    return whole.dropDuplicates().withColumn("tie", F.xxhash64("label", "whole")).withColumn("dim", F.size("whole"))


def _blocks(rows: DataFrame, block: int, name: str, more: Sequence[str] = ()) -> DataFrame:
    """Rows packed by dimension and label into blocks of about ``block`` numbers, dealt by a hash, so that a label may hold any share of the rows."""
    group = ["dim", "label"]
    n = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    parts = rows.join(n, group).withColumn("part", F.pmod(F.xxhash64("vec_id", "tie"), F.ceil(F.col("_n") * F.col("dim") / block)))
    item = F.struct("vec_id", "tie", "whole", *more)
    return staged(parts.groupBy(*group, "part").agg(F.collect_list(item).alias("rows")), name)


def _compare(left: DataFrame, right: DataFrame, same: bool, windows: int, k: int, lengths: Sequence[int]) -> DataFrame:
    """Best rows of every block of ``right`` for the anchors of every block of ``left`` that may meet it: equal labels, or different ones."""
    heads = left.select("dim", F.col("label").alias("label1"), F.col("part").alias("part1"))
    tails = right.select("dim", F.col("label").alias("label2"), F.col("part").alias("part2"))
    # blocks, not rows, meet here: a stated set of anchors against all rows
    pairs = heads.join(tails, "dim").where("label1 = label2" if same else "label1 <> label2")
    both = (pairs.join(left.withColumnsRenamed({"label": "label1", "part": "part1", "rows": "rows1"}), ["dim", "label1", "part1"])
            .join(right.withColumnsRenamed({"label": "label2", "part": "part2", "rows": "rows2"}), ["dim", "label2", "part2"])
            .select("dim", "label1", "part1", "label2", "part2", "rows1", "rows2"))
    both = both.repartition(partitions(left), "dim", "label1", "part1", "label2", "part2").select("rows1", "rows2")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def unpack(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, Summaries, pa.StructArray, np.ndarray]:
            own = rows.values
            ids, tie = own.field("vec_id").to_numpy(), own.field("tie").to_numpy()
            order = np.lexsort((tie, ids))  # rows by id, so that ties go to the smaller one
            own = own.take(pa.array(order))
            flat = own.field("whole").flatten().to_numpy().reshape(len(order), -1)
            return ids[order], tie[order], Summaries(flat, lengths), own

        for batch in batches:
            for one, two in zip(batch.column("rows1"), batch.column("rows2")):
                id1, tie1, a, own = unpack(one)
                id2, tie2, b, _ = unpack(two)
                if windows:
                    limits = own.field("windows").flatten()
                    upto = np.concatenate(([0], np.cumsum([len(x) for x in own.field("windows")])))
                    every = [np.full(len(id1), v, dtype=np.int64) for _ in range(windows) for v in (1, 0)]
                    for w in range(windows):  # anchors with fewer windows keep empty ones
                        has = np.flatnonzero(np.diff(upto) > w)
                        every[2 * w][has] = limits.field("low").to_numpy()[upto[has] + w]
                        every[2 * w + 1][has] = limits.field("high").to_numpy()[upto[has] + w]
                    wanted = list(zip(every[::2], every[1::2]))
                    allowed = None
                else:
                    edge = np.iinfo(np.int64)
                    wanted = [(np.full(len(id1), edge.min + 1), np.full(len(id1), edge.max))]
                    allowed = lambda t: (id1[t, None] != id2[None, :]) | (tie1[t, None] != tie2[None, :])
                out: list[list[np.ndarray]] = [[], [], [], [], [], []]
                # one more for the anchor itself, which bounds cannot tell from the others
                for i, w, j, score in best(a, b, wanted, k + (not windows), allowed):
                    j, score = j[:k], score[:k]
                    for column, value in zip(out, (np.full(len(j), id1[i]), np.full(len(j), tie1[i]), np.full(len(j), w), id2[j], tie2[j], score)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in out],
                    names=["anchor_id", "anchor_tie", "at", "vec_id", "tie", "score"])

    return both.mapInArrow(run, "anchor_id long, anchor_tie long, at long, vec_id long, tie long, score long")


def mine(vectors: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         lengths: Sequence[int] = (16, 8, 4), block: int = 1 << 18) -> DataFrame:
    """Per anchor and positive, the hardest negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, embedding``.  Scores are inner products of ``floor(256 * x)``; the higher comes first, of
    equal ones the smaller id.  An anchor's positives are its best other rows of equal label; negatives are the best
    rows of another label whose score lies between ``low`` and ``high`` hundredths of the positive's.  Which rows take
    part is said at ``usable``; vectors of different dimensions are never compared.

    Blocks of anchors meet blocks of rows: only blocks of equal label for positives, only others for negatives.
    Each meeting keeps a few rows per anchor, and a ranked window over each anchor's few best rows per block
    joins them.  ``lengths`` are the segment lengths of the summaries, coarse to fine; ``block`` is in numbers, not rows.
    """
    rows = staged(usable(vectors), "negative_rows")
    blocks = _blocks(rows, block, "negative_blocks")
    anchors = rows.where(anchor)
    order = [F.desc("score"), "vec_id", "tie"]
    near = _compare(_blocks(anchors, block, "negative_anchors"), blocks, True, 0, positives, lengths)
    key = ["anchor_id", "anchor_tie"]
    near = near.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("n") <= positives)
    near = staged(near.select(*key, "n", "vec_id", "score"), "negative_positives")
    # whole numbers from ceil(low * score / 100) to floor(high * score / 100), without leaving LONG
    part = lambda p: F.expr(f"(score div 100) * {p} + ((score % 100) * {p}) div 100")
    rest = lambda p: F.expr(f"((score % 100) * {p}) % 100")
    found = near.select(*key, "n", (part(low) + F.when(rest(low) > 0, 1).otherwise(0)).alias("low"),
                        (part(high) - F.when(rest(high) < 0, 1).otherwise(0)).alias("high"))
    limits = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "low", "high"))).alias("windows"))
    wanted = anchors.join(limits.withColumnsRenamed({"anchor_id": "vec_id", "anchor_tie": "tie"}), ["vec_id", "tie"])
    hard = _compare(_blocks(wanted, block, "negative_windows", ["windows"]), blocks, False, positives, negatives, lengths)
    each = Window.partitionBy(*key, "at").orderBy(*order)
    hard = hard.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
    hard = hard.select(*key, (F.col("at") + 1).cast("int").alias("n"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (near.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}).join(hard, [*key, "n"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
