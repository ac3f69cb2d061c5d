"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import partitions, staged


def min_cost_flow(have: Sequence[int], room: Sequence[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes to send from old shard i to new shard j at the least total cost, ``{(i, j): bytes}``.

    Successive shortest paths with potentials over the graph source, old, new, sink; costs must not be
    negative.  By default staying costs nothing and any move one per byte.  The graph has one node per
    shard, so its size does not depend on the data.  The room must suffice for all bytes.
    """
    n, m = len(have), len(room)
    if sum(have) > sum(room):
        raise ValueError("the new shards are too small")
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, capacity left, cost; the reverse edge is the next or previous one
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(u: int, v: int, cap: int, price: int) -> None:
        for a, b, c, p in ((u, v, cap, price), (v, u, 0, -price)):
            at[a].append(len(edges))
            edges.append([b, c, p])

    for i in range(n):
        link(source, i, have[i], 0)
        for j in range(m):
            link(i, n + j, have[i], cost(i, j))
    for j in range(m):
        link(n + j, sink, room[j], 0)
    height, left = [0] * (n + m + 2), sum(have)
    while left:
        far: list[float] = [float("inf")] * (n + m + 2)
        far[source], via, heap = 0, [-1] * (n + m + 2), [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in at[u]:
                v, cap, price = edges[e]
                reach = d + price + height[u] - height[v]
                if cap and reach < far[v]:
                    far[v], via[v] = reach, e
                    heapq.heappush(heap, (reach, v))
        height = [h + (0 if f == float("inf") else f) for h, f in zip(height, far)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        amount = min(left, *(edges[e][1] for e in path))
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
        left -= amount
    return {(i, edges[e][0] - n): edges[e ^ 1][1] for i in range(n) for e in at[i]
            if n <= edges[e][0] < n + m and edges[e ^ 1][1]}


def _numbered(rows: DataFrame, keys: list[str], block: str, order: list[Column], size: Column, total: str) -> DataFrame:
    """``rows`` with ``total``, the sum of ``size`` over all earlier rows of ``keys``.

    Sums of blocks are running totals over few rows; inside a block rows are ordered.  No task holds more than a block.
    """
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, block).agg(F.sum(size).alias("_all"))
    ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, block, F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_ahead"))
    return (rows.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(blocks, [*keys, block])
            .withColumn(total, F.col("_in") + F.col("_ahead")).drop("_in", "_ahead"))


def _cut_hot(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """The last of ``keys`` becomes a struct of itself and a part, 0 but in blocks of many rows.

    Hashes are even over distinct rows, so only a fully repeated row fills a block beyond four times ``block_rows``.
    Its repeats are alike, and so are dealt out by their place in the staged file.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * block_rows)
    part = F.when(F.col("_n").isNotNull(), F.pmod("_row", F.ceil(F.col("_n") / block_rows))).otherwise(F.lit(0)).cast("long")
    return rows.join(sizes, keys, "left").withColumn(keys[-1], F.struct(F.col(keys[-1]).alias("block"), part.alias("part"))).drop("_n", "_row")


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8


def _sum() -> Column:
    return F.crc32(F.col("text").cast("binary"))


def reshard(docs: DataFrame, old: Column, n_old: int, n_new: int, capacities: Sequence[int] | None = None,
            block_rows: int = 20_000, keep: Sequence[str] = ()) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """New shards of documents by bytes, and the flow they follow.

    ``old`` numbers the present shard, 0 to ``n_old - 1``.  A document weighs its UTF-8 bytes (a missing text
    none) plus 8.  Capacities default to even ones.  The line of documents of an old shard is cut where the
    flow says; a document belongs to the piece that holds its middle.  Larger documents stand first, so
    cuts fall among small ones where the shard has them, and a shard misses its capacity by no more than about
    a document per piece.  Equal ids are told apart by their text, and a row that is repeated more often than a block
    holds stands in several blocks.

    Rows: ``doc_id, size, text_crc32, old_shard, shard, slot`` and the columns ``keep`` of ``docs``; ``slot`` counts from 0
    within a shard without gaps.
    """
    rows = docs.select("doc_id", _size().alias("size"), _sum().alias("text_crc32"),
                       old.cast("int").alias("old_shard"), F.xxhash64("doc_id", "text").alias("_hash"), F.monotonically_increasing_id().alias("_row"), *keep)
    rows = staged(rows, "shard_sizes")
    sizes = {r["old_shard"]: (r["b"], r["n"]) for r in rows.groupBy("old_shard").agg(
        F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    have = [sizes.get(i, (0, 0))[0] for i in range(n_old)]
    total, count = sum(have), sum(n for _, n in sizes.values())
    room = list(capacities) if capacities else [total // n_new + (j < total % n_new) for j in range(n_new)]
    flow = min_cost_flow(have, room)
    # blocks: size classes from large to small, each in as many parts as keep a block near block_rows rows
    parts = max(1, count // block_rows)
    rows = rows.withColumn("_block", (F.lit(64) - F.ceil(F.log2("size"))) * parts + F.pmod("_hash", F.lit(parts)))
    rows = _cut_hot(rows, ["old_shard", "_block"], block_rows)
    order = [F.col("_hash"), F.col("doc_id"), F.col("size")]
    lined = _numbered(rows, ["old_shard"], "_block", order, F.col("size"), "_start")
    shard = F.lit(None).cast("int")
    for i in range(n_old):
        piece, cut, last = None, 0, None
        targets = sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j))
        for j in targets:
            cut, last = cut + flow[i, j], j
            inside = F.col("_start") + F.col("size") / 2 < cut
            piece = F.when(inside, j) if piece is None else piece.when(inside, j)
        if piece is not None:
            shard = F.when(F.col("old_shard") == i, piece.otherwise(last)).otherwise(shard)
    placed = lined.withColumn("shard", shard).withColumn("_spot", F.struct("old_shard", "_block"))
    placed = _numbered(placed, ["shard"], "_spot", [F.col("_start"), *order], F.lit(1), "slot")
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot").cast("long").alias("slot"), *keep), flow


def _free(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened by underscores while a column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _files(docs: DataFrame, folder: str, shard: int, column: str = "shard"):
    """The file system and the path of a shard's folder, and the names of its files."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{column}={shard}")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, path, {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()


def rewrite(docs: DataFrame, shard: Column, affected: Sequence[int], folder: str) -> str:
    """Write the documents of the affected shards, one folder ``shard=N`` each; other folders stay as they are.

    Gives the name of the column that numbers the shards: ``shard``, or with underscores behind it where ``docs`` has a column of that name.
    Rows are dealt by shard and a salt, so a shard is written by several tasks.  An
    affected shard that gets no rows is not touched by the write; it has only files from before and is removed afterwards.
    """
    affected, name = [int(s) for s in affected], _free("shard", docs.columns)
    out = docs.withColumn(name, shard).where(F.col(name).isin(*affected))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns]), F.lit(8))
    _write(out.repartition(partitions(docs), name, salt), name, affected, folder)
    return name


def _write(rows: DataFrame, name: str, affected: Sequence[int], folder: str) -> None:
    before = {s: _files(rows, folder, s, name)[2] for s in affected}
    conf = rows.sparkSession.conf
    mode = conf.get("spark.sql.sources.partitionOverwriteMode")
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy(name).parquet(folder)
    finally:
        conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    for s in affected:
        fs, path, names = _files(rows, folder, s, name)
        if names & before[s]:
            fs.delete(path, True)


def affected(flow: dict[tuple[int, int], int]) -> list[int]:
    """Shards whose content changes: both ends of every transfer between different shards."""
    return sorted({s for i, j in flow if i != j for s in (i, j)})


def move(docs: DataFrame, old: Column, n_old: int, n_new: int, folder: str,
         capacities: Sequence[int] | None = None) -> DataFrame:
    """Reshard documents that are read from Parquet files and write the affected shards, with all columns, to ``folder``.

    A row is known by its file and its place there, so repeated rows are told apart and none is a hot key.  Where the documents have columns
    called ``shard``, ``old_shard`` or ``slot``, the files' columns of that meaning get underscores behind their names.  Texts are
    shuffled once, and each task writes a file per shard.  Rows as in ``reshard``: those of affected shards are read back
    from the written files, the others stay where they are.
    """
    spark, at, own = docs.sparkSession, ("_file", "_at"), ("old_shard", "slot")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    # the documents' own columns travel as one, so that their names don't matter
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text", old.alias("_old"), *place)
    placed, flow = reshard(packed, F.col("_old"), n_old, n_new, capacities, keep=at)
    placed, changed = staged(placed, "shard_places"), affected(flow)
    kept = placed.where(~F.col("shard").isin(*changed)).drop(*at)
    if not changed:
        return kept
    moved = placed.where(F.col("shard").isin(*changed)).select(*at, F.struct(*own, "shard").alias("_to"))
    met = packed.select("_doc", *at).repartition(partitions(docs), *at).join(moved, list(at))
    # in the files, names of this operator give way to those of the documents
    names = {c: _free(c, [*docs.columns, "shard"]) for c in own}
    name = _free("shard", docs.columns)
    rows = met.select("_doc.*", *[F.col(f"_to.{c}").alias(n) for c, n in names.items()], F.col("_to.shard").alias(name))
    _write(rows, name, changed, folder)
    written = spark.read.schema(rows.schema).parquet(folder).where(F.col(name).isin(*changed))
    return kept.unionByName(written.select(
        "doc_id", _size().alias("size"), _sum().alias("text_crc32"), *[F.col(n).alias(c) for c, n in names.items()], F.col(name).alias("shard")))
