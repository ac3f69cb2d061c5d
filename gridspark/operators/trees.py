"""Tree growth inside a task: split choice on histograms, level by level, and the packed form trees are scored in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np

U = np.uint64
CELLS = 1 << 21     # histogram cells held at a time


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit mix of integers, the same on every machine."""
    h = np.asarray(h).astype(np.int64).view(U)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bag: Poisson(1) by a hash of row key and tree, so left-out rows are known without a list."""
    total, term, cuts = 0.0, float(np.exp(-1)), []
    for i in range(12):
        total += term
        cuts.append(total)
        term /= i + 1
    salt = mixed(np.array([tree * 1_000_003 + seed]))
    u = (mixed((keys.astype(np.int64).view(U) ^ salt).view(np.int64)) >> U(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(np.array(cuts), u, side="right")


@dataclass(frozen=True)
class Growth:
    """What is grown: ``kind`` is ``class`` (statistics: weight per class), ``number`` (weight, weighted target) or ``boost`` (rows,
    gradient, hessian); a node splits while it has ``min_split`` and its children ``min_leaf`` weight."""

    kind: str
    bins: int = 64
    depth: int | None = None
    min_split: float = 2
    min_leaf: float = 1
    subset: int | None = None       # features tried per node, all if None
    ridge: float = 1.0              # boost only
    seed: int = 42

    def weight(self, s: np.ndarray) -> np.ndarray:
        return s.sum(axis=-1) if self.kind == "class" else s[..., 0]

    def score(self, s: np.ndarray) -> np.ndarray:
        """What a split raises: sum of squares over weight (Gini, variance), or the second-order gain of a boosted leaf."""
        if self.kind == "boost":
            return s[..., 1] ** 2 / (s[..., 2] + self.ridge)
        top = (s ** 2).sum(axis=-1) if self.kind == "class" else s[..., 1] ** 2
        return top / np.maximum(self.weight(s), 1e-300)

    def value(self, s: np.ndarray) -> np.ndarray:
        """Leaf values: class shares, mean, or the boosted step."""
        if self.kind == "boost":
            return (-s[:, 1] / (s[:, 2] + self.ridge))[:, None]
        w = np.maximum(self.weight(s), 1e-300)[:, None]
        return s / w if self.kind == "class" else s[:, 1:2] / w


def tried(names: np.ndarray, features: int, growth: Growth) -> np.ndarray:
    """The features each node tries, in ascending order, drawn by its name and the seed."""
    draw = mixed(names[:, None] * 1009 + np.arange(features)[None, :] + growth.seed * 7919)
    return np.sort(np.argsort(draw, axis=1, kind="stable")[:, :growth.subset], axis=1)


def best_splits(hist: np.ndarray, growth: Growth, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none), cut and gain per node of ``hist`` [node, feature, bin, statistic]; bins up to the cut go left.

    ``names`` numbers the nodes; with them and the seed the features to try are drawn.  A node where none of those
    splits tries all.
    """
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[:, :1].sum(axis=2, keepdims=True)
    right = total - left
    least = max(growth.min_leaf, 1e-9)
    able = (growth.weight(left) >= least - 1e-9) & (growth.weight(right) >= least - 1e-9)
    able &= (growth.weight(total) >= growth.min_split - 1e-9)
    gain = np.where(able, growth.score(left) + growth.score(right) - growth.score(total), 0.0)
    flat = gain.reshape(len(hist), -1)
    if growth.subset and growth.subset < hist.shape[1]:
        among = np.zeros(hist.shape[:2], dtype=bool)
        np.put_along_axis(among, tried(names, hist.shape[1], growth), True, axis=1)
        part = np.where(among[:, :, None], gain, 0.0).reshape(len(hist), -1)
        flat = np.where(part.max(axis=1, initial=0.0)[:, None] > 1e-12, part, flat)
    if not flat.shape[1]:
        return np.full(len(hist), -1), np.zeros(len(hist), dtype=np.int64), np.zeros(len(hist))
    pick = flat.argmax(axis=1)
    best = flat[np.arange(len(hist)), pick]
    feature, cut = np.divmod(pick, hist.shape[2] - 1)
    return np.where(best > 1e-12, feature, -1), cut, best


def histograms(x: np.ndarray, stats: np.ndarray, slot: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """Sums of the rows' statistics by slot, feature and bin."""
    n, f = x.shape
    cell = ((slot[:, None] * f + np.arange(f)) * bins + x).ravel()
    out = [np.bincount(cell, np.repeat(stats[:, s], f), slots * f * bins) for s in range(stats.shape[1])]
    return np.stack(out, axis=1).reshape(slots, f, bins, -1)


def _split_rows(x: np.ndarray, stats: np.ndarray, slot: np.ndarray, growth: Growth, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_splits`` of rows in memory.  Histograms are made of the tried features only, and of all for nodes these don't split."""
    n = len(names)
    if not growth.subset or growth.subset >= x.shape[1]:
        return best_splits(histograms(x, stats, slot, n, growth.bins), growth, names)
    few = tried(names, x.shape[1], growth)
    every = replace(growth, subset=None)
    feature, cut, gain = best_splits(histograms(np.take_along_axis(x, few[slot], axis=1), stats, slot, n, growth.bins), every, names)
    feature = np.where(feature >= 0, few[np.arange(n), feature], -1)
    again = np.flatnonzero(feature < 0)
    rows = np.flatnonzero(np.isin(slot, again))
    if len(rows):
        found = best_splits(histograms(x[rows], stats[rows], np.searchsorted(again, slot[rows]), len(again), growth.bins), every, names[again])
        feature[again], cut[again], gain[again] = found
    return feature, cut, gain


@dataclass
class Nodes:
    """A tree: per node feature (-1: a leaf), cut, children, value, weight and gain."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64) if at is None else at.copy()
        busy = np.flatnonzero(self.feature[at] >= 0)
        while len(busy):
            node = at[busy]
            low = x[busy, self.feature[node]] <= self.cut[node]
            at[busy] = np.where(low, self.left[node], self.right[node])
            busy = busy[self.feature[at[busy]] >= 0]
        return at


def grow(x: np.ndarray, stats: np.ndarray, growth: Growth, name: int = 0, depth: int = 0) -> tuple[Nodes, np.ndarray]:
    """Grow one tree, or the rest of one below depth ``depth``, on rows held in memory; also the leaf of each row.

    All nodes of a level are split at once, as many as histograms of ``CELLS`` cells hold.
    """
    at = np.zeros(len(x), dtype=np.int64)
    parts: list[list[np.ndarray]] = []
    first, level = 0, np.array([stats.sum(axis=0)])
    live = np.arange(len(x))
    step = max(1, CELLS // (x.shape[1] * growth.bins * stats.shape[1]))
    names = np.array([name], dtype=np.int64)
    while len(level):
        n = len(level)
        feature, cut, gain = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n)
        open_ = growth.weight(level) >= growth.min_split - 1e-9
        if growth.kind == "class":
            open_ &= level.max(axis=1) < growth.weight(level) - 1e-9  # rows of one class stay together
        if growth.depth is not None and depth >= growth.depth:
            open_[:] = False
        live = live[open_[at[live] - first]]
        live = live[np.argsort(at[live], kind="stable")]
        slot = at[live] - first
        for s in range(0, n, step):
            a, b = np.searchsorted(slot, [s, s + step])
            if a < b:
                rows = live[a:b]
                feature[s:s + step], cut[s:s + step], gain[s:s + step] = _split_rows(x[rows], stats[rows], slot[a:b] - s, growth, names[s:s + step])
        split = np.flatnonzero(feature >= 0)
        left, right = np.full(n, -1), np.full(n, -1)
        left[split] = first + n + 2 * np.arange(len(split))
        right[split] = left[split] + 1
        parts.append([feature, cut, left, right, growth.value(level), growth.weight(level), gain])
        live = live[feature[at[live] - first] >= 0]
        node = at[live] - first
        low = x[live, feature[node]] <= cut[node]
        at[live] = np.where(low, left[node], right[node])
        names = np.repeat(names[split] * 2, 2) + np.tile([1, 2], len(split))
        first, depth = first + n, depth + 1
        size = 2 * len(split)
        level = np.stack([np.bincount(at[live] - first, stats[live, s], size) for s in range(stats.shape[1])], axis=1) if size else np.zeros((0, stats.shape[1]))
    return Nodes(*[np.concatenate(c) for c in zip(*parts)]), at


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many edges lie below a value; a missing value counts as the smallest."""
    out = [np.searchsorted(e, np.nan_to_num(np.asarray(c, dtype=np.float64), nan=-np.inf), side="left") for c, e in zip(columns, edges)]
    return np.stack(out, axis=1).astype(np.uint8)
