"""Near-duplicate embeddings: int8 tile products with proven error bounds, doubtful pairs in full precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import components, local_roots, partitions, staged

STEP = 1 / 32  # width of a bucket of projections
PAIRS = 1 << 16  # pairs recomputed at a time


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8, their scales, and the norm of what rounding took from each row (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return q, scale, error


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to 0.5 .. 1: no bit is lost, and no square overflows or vanishes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 tiles; float32 holds every partial sum up to 2^24 exactly."""
    block = (1 << 24) // (127 * 127)
    total = np.zeros((len(a), len(b)), dtype=np.float64) if a.shape[1] > block else None
    for s in range(0, a.shape[1], block):
        part = a[:, s:s + block].astype(np.float32) @ b[:, s:s + block].astype(np.float32).T
        if total is None:
            return part
        total += part
    return total


def linked(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (doubles, none zero) whose cosine in double precision is ``least`` or more.

    With x = x' + e, where x' is the int8 form, x.y = x'.y' + x'.f + e.y, so the product of the int8 forms
    misses the cosine by at most (1 + |e|) |f| + |e|.  Only pairs that may reach ``least`` are recomputed.
    """
    a, b = scaled(a), scaled(b)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ea = quantise(a / na[:, None])
    qb, sb, eb = quantise(b / nb[:, None])
    rows, cols = [], []
    for s in range(0, len(a), 256):  # a strip at a time bounds the memory
        t = slice(s, s + 256)
        near = tile_product(qa[t], qb) * sa[t, None] * sb[None, :]
        slack = (1 + ea[t, None]) * eb[None, :] + ea[t, None] + 1e-9
        i, j = np.nonzero(near + slack >= least)
        for p in range(0, len(i), PAIRS):
            x, y = i[p:p + PAIRS] + s, j[p:p + PAIRS]
            ok = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= least
            rows.append(x[ok])
            cols.append(y[ok])
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate(rows or [empty]), np.concatenate(cols or [empty])


def near_duplicates(vectors: DataFrame, least: float = 0.98, tile: int = 2048) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows are compared within a label and a dimension; rows whose label is missing, or whose vector is missing,
    empty, zero or holds a missing or non-finite value, link with nothing.  Equal vectors of a label are one node
    that counts its copies, and all copies of one node link with each other.  Rows that share a ``vec_id`` stay rows of their own.

    Vectors with cosine c lie within sqrt(2 - 2 c) of each other once scaled to length one, and so do their
    projections on any direction.  Tiles are buckets of one projection, cut by a hash to about ``tile`` rows; only tiles
    whose buckets lie that close are multiplied.  A tile pair reports a count of links and a root per vector, never its pairs.
    """
    ok = (F.col("label").isNotNull() & (F.size("embedding") > 0)
          & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists("embedding", lambda x: x != 0))
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # minus zero becomes zero
    valid = vectors.select("vec_id", "label", "embedding").where(F.coalesce(ok, F.lit(False))).withColumn("embedding", plain)
    node = F.md5(F.concat(F.col("label").cast("string"), F.lit("|"), F.col("embedding").cast("string")))
    nodes = staged(valid.select("vec_id", "label", "embedding", node.alias("node")).groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.min("vec_id").alias("low"), F.count("*").alias("copies")), "vector_nodes")
    # a fixed direction: signs from a hash of the position, so the projection is at most 1 in size
    sign = lambda i: F.when(F.pmod(F.xxhash64(i), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    large = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    # divided by the largest component, bound once per row, as squares of tiny or huge values would be lost
    shape = F.transform(F.array(large), lambda m: F.transform("embedding", lambda x: x.cast("double") / m))[0]
    formed = nodes.withColumn("shape", shape)
    dot = F.aggregate(F.transform("shape", lambda x, i: x * sign(i)), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("shape", F.lit(0.0), lambda s, x: s + x * x))
    placed = formed.select("node", "label", "embedding", "copies", F.size("embedding").alias("dim"),
                          F.floor(dot / norm / F.sqrt(F.size("embedding").cast("double")) / F.lit(STEP)).alias("bucket"))
    group = ["label", "dim", "bucket"]
    counts = placed.groupBy(*group).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / tile)
    sized = placed.join(counts, group).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    key = [*group, "part"]
    tiles = staged(sized.groupBy(*key).agg(F.collect_list(F.struct("node", "copies", "embedding")).alias("rows")), "vector_tiles")
    heads = tiles.select(*key, F.struct("bucket", "part").alias("tile"))
    reach = int(np.ceil(np.sqrt(max(0.0, 2 - 2 * least)) / STEP + 1e-6))
    right = heads.select("label", "dim", F.col("bucket").alias("near"), F.col("tile").alias("tile2"))
    pairs = (heads.withColumn("near", F.explode(F.sequence(F.col("bucket"), F.col("bucket") + reach)))
             .join(right, ["label", "dim", "near"]).where("tile <= tile2")
             .select("label", "dim", F.col("tile").alias("tile1"), "tile2"))
    packed = tiles.select("label", "dim", F.struct("bucket", "part").alias("tile"), "rows")
    first = packed.withColumnsRenamed({"tile": "tile1", "rows": "rows1"})
    second = packed.withColumnsRenamed({"tile": "tile2", "rows": "rows2"})
    both = (pairs.join(first, ["label", "dim", "tile1"]).join(second, ["label", "dim", "tile2"])
            .select((F.col("tile1") == F.col("tile2")).alias("same"), "rows1", "rows2"))
    both = both.repartition(partitions(vectors), F.xxhash64(F.col("rows1")[0]["node"], F.col("rows2")[0]["node"]))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def unpack(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = rows.values
            flat = own.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            return (own.field("node").to_numpy(zero_copy_only=False), own.field("copies").to_numpy(zero_copy_only=False),
                    flat.reshape(len(own), -1))

        for batch in batches:
            for same, left, right in zip(*[batch.column(c) for c in ("same", "rows1", "rows2")]):
                n1, c1, a = unpack(left)
                n2, c2, b = unpack(right)
                i, j = linked(a, b, least)
                if same.as_py():
                    i, j = i[i < j], j[i < j]
                    names, j = n1, j
                    copies = c1
                else:
                    names, j = np.concatenate([n1, n2]), j + len(n1)
                    copies = np.concatenate([c1, c2])
                links = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
                root = local_roots(len(names), i, j)
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(names[hit], pa.string()), "b": pa.array(names[root[hit]], pa.string()),
                    "n": pa.array(links[hit].astype(np.int64), pa.int64())})

    found = staged(both.mapInArrow(compare, "a string, b string, n long"), "vector_links")
    n_links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    comp = nodes.select("node", "low", "copies").join(components(found.select("a", "b")), "node", "left").withColumn(
        "root", F.coalesce("root", "node")).join(n_links, "node", "left")
    lows = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    info = comp.join(lows, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = vectors.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), F.md5(F.concat(
        F.col("label").cast("string"), F.lit("|"), plain.cast("string")))).alias("node"))
    return rows.join(info, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))
