"""Pieces the operators share: words, stages in the shared folder, links to components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import shared_folder

#: A word is a run of anything but the ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """The words of a text as an array; a missing text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_lowest(links: DataFrame, hot: int) -> DataFrame:
    """``a, b, m`` of links ``(a, b)``, where m is the smallest b of each a.

    Minima are aggregated before the shuffle and joined back.  Nodes with more than ``hot`` links get theirs by a broadcast instead, so
    the links of none meet in one task; there are at most as many of them as ``hot`` goes into the number of links.
    """
    low = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    many = F.broadcast(low.where(F.col("n") > hot).select("a", F.col("m").alias("known")))
    met = links.join(many, "a", "left")
    rest = met.where("known IS NULL").select("a", "b").join(low.where(F.col("n") <= hot).select("a", "m"), "a")
    return met.where("known IS NOT NULL").select("a", "b", F.col("known").alias("m")).unionByName(rest.select("a", "b", "m"))


def components(links: DataFrame, name: str = "components", hot: int | None = None) -> DataFrame:
    """Connected components of undirected links ``(a, b)``: rows ``(node, root)`` for every node but the roots.

    Alternating large and small stars: each round points neighbours at the smallest node
    known around them, and every round is written to the shared folder.  A node is hot from ``hot`` links on, by default
    a quarter of an even partition (at least 1,000), so at most eight per partition are.
    """
    deal = partitions(links)
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = staged(stars, name)
    seen, count = None, stars.count()
    while True:
        most = hot or max(1000, count // (4 * deal))
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_with_lowest(both, most).where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        small = _with_lowest(large, most)
        small = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(small.where("b = m").select("a", F.col("m").alias("b"))).distinct())
        stars = staged(small, name)
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, count = now, now[0]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes reaches over the links ``i - j``."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new
