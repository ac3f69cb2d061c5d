"""SimHash fingerprints, linked through Burkhard-Keller trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import components, local_roots, partitions, staged

BLOCKS = 4  # of 16 bits
QUERIES = 4096  # that walk the trees together


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is set if it is set in over half of the XXH64 values of the word shingles.

    Words are runs of non-blank ASCII bytes or any others, with A-Z made lower case.  Shingles lie side by side in
    the words joined by single blanks, so each is a slice of them.  Fewer words give one shingle of all; none give zero.
    """
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for s in range(0, n, 1 << 16):
        part = hashes[s:s + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, tie, fp`` (a signed long) of every whole text; a missing text has no words."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column("data")], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "fp": pa.array(fps.view(np.int64))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("data"))
    return own.mapInArrow(run, "doc_id long, tie long, fp long")


class Forest:
    """One tree per group.  A child's key is its distance to the parent; all trees grow and are searched level by level."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """``group`` numbers the tree of each value, in ascending order."""
        self.values = values
        _, self.roots, which = np.unique(group, return_index=True, return_inverse=True)
        at = self.roots[which]
        todo = np.setdiff1d(np.arange(len(values)), self.roots, assume_unique=True)
        edges, nodes = [], []
        while len(todo):
            key = at[todo] * 65 + np.bitwise_count(values[todo] ^ values[at[todo]])
            known, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = todo[first]
            edges.append(known)
            nodes.append(child)
            at[todo] = child[back]
            rest = np.ones(len(todo), dtype=bool)
            rest[first] = False
            todo = todo[rest]
        keys = np.concatenate(edges) if edges else np.empty(0, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], (np.concatenate(nodes) if nodes else keys)[order]

    def near(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, value) at most ``radius`` apart.  By the triangle inequality only edges within ``radius`` of the
        distance to a node can lead to one.  ``tree`` numbers the tree each query searches."""
        for s in range(0, len(queries), QUERIES):
            q = np.arange(s, min(s + QUERIES, len(queries)))
            node = self.roots[tree[q]]
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                yield q[d <= radius], node[d <= radius]
                low = np.maximum(d - radius, 0)
                lo = np.searchsorted(self.keys, node * 65 + low)
                n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - lo
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                q, node = np.repeat(q, n), self.child[np.repeat(lo, n) + step]


def _link(groups: np.ndarray, home: np.ndarray, ask: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of complete groups, ordered by group: each value that has a link with the smallest value it reaches in its group.

    Values of ``home`` form the group's tree, which those of ``ask`` search.
    """
    own = np.flatnonzero(home)
    if not len(own):
        return fps[:0], fps[:0]
    forest = Forest(fps[own].view(np.uint64), groups[own])
    ask = np.flatnonzero(ask & np.isin(groups, groups[own]))
    tree = np.searchsorted(np.unique(groups[own]), groups[ask])
    low = np.arange(len(fps))
    for q, v in forest.near(fps[ask].view(np.uint64), tree, radius):
        q, v = ask[q], own[v]
        keep = (q != v) & (low[q] != low[v])
        low = low[local_roots(len(fps), low[q[keep]], low[v[keep]])[low]] if keep.any() else low
    hit = np.flatnonzero(low != np.arange(len(fps)))
    return fps[hit], fps[low[hit]]


def near_links(values: DataFrame, radius: int = 2, tree_rows: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct ``fp`` of ``values`` exactly as all pairs at most ``radius`` (2 or less) apart do.

    Of four blocks of bits at least two agree in such a pair, so values meet under each of the six pairs of blocks.
    Those of one key form a shard with a tree of its own, held only by the task that has the shard's queries.  A key with more
    than ``tree_rows`` values is cut into shards of about that many, and every two of its shards meet once, one as a tree and one as its
    queries; so the largest group has about twice ``tree_rows`` values, whatever a key holds.
    """
    import pyarrow as pa

    if radius > 2:
        raise ValueError("two equal blocks of four are certain up to radius 2 only")
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    keys = F.array(*[F.lit((i * BLOCKS + j)).cast("long") * F.lit(1 << 32) + block[i] * F.lit(1 << 16) + block[j]
                     for i in range(BLOCKS) for j in range(i)])
    rows = values.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / tree_rows).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), shards)).withColumn("other", other).select(
        "key", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asks"), "fp",
        (F.col("own") <= F.col("other")).alias("home"), (F.col("own") >= F.col("other")).alias("ask"))
    group = ["key", "tree", "asks"]
    rows = rows.repartition(partitions(values), *group).sortWithinPartitions(*group, F.desc("home"))

    def _starts(table) -> np.ndarray:
        """Whether a row is the first of its group."""
        cols = [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy() for c in group]
        return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))

    def run(batches: Iterator) -> Iterator:
        for batch in _complete(batches):
            home, ask, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home", "ask", "fp"))
            a, b = _link(np.cumsum(_starts(batch)) - 1, home, ask, np.ascontiguousarray(fps), radius)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def _complete(batches: Iterator, least: int = 50_000) -> Iterator:
        """Batches cut between groups."""
        held: list = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < least:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_starts(table))[-1])
            if cut:
                yield table.slice(0, cut).combine_chunks().to_batches()[0]
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
        if count:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id, tie`` (a hash of the text), ``fingerprint`` (16 hex digits), ``component_id``, the smallest
    ``doc_id`` reachable over fingerprints at most ``radius`` bits apart, and ``kept``.

    Documents without words have fingerprint zero and link with each other.  A missing ``doc_id`` joins a component but names it
    only if it holds no other id.  ``kept`` marks the smallest ``(doc_id, tie)`` of each component, a missing id last; fully
    repeated rows are all marked, or none.
    """
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    nodes = prints.groupBy("fp").agg(F.min(first).alias("low"))
    roots = components(near_links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("low").alias("low"))
    info = named.drop("low").join(lows, "root").select("fp", "low")
    return prints.join(info, "fp").select(
        "doc_id", "tie", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("tie") == F.col("low.tie"))).alias("kept"))


def one_of_each(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """``docs`` with one row per component; of fully repeated ids and texts one is taken."""
    keys = near_duplicates(docs, radius, shingle).where("kept").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tie"))
    met = own.join(keys, own["_id"].eqNullSafe(keys["_id"]) & (own["_tie"] == keys["_tie"])).select("_row", own["_id"], own["_tie"])
    return met.dropDuplicates(["_id", "_tie"]).select("_row.*")
