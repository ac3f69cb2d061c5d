"""Periodic runs of words, found from a dictionary of basic factors, and texts with each run collapsed to its first period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import words

CHUNK = 4 << 20     # bytes of text looked at together; a longer text is looked at alone
RUN = "struct<start:long,length:long,period:long>"


def find_runs(ids: np.ndarray, ends: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs ``start, length, period`` in sequences laid end to end; ``ends`` holds for each word where its sequence ends.

    For each power of two L, equal stretches of L words carry equal names, made from pairs of names of the level below
    (the dictionary of basic factors).  Where a stretch occurs again d <= L words later, both lie
    within twice its length: its occurrences there form an arithmetic progression with difference d, and d is proposed as a period.  Proposals at
    neighbouring places with one d are extended to one run: it begins at the first of them, and ends L + d words after the last one.

    A run of smallest period q and at least 4 q words holds a power of two L with q <= L < 2 q, and L + q <= 3 q words.  Inside it a stretch
    of L words comes again after q words and no sooner (it would have a smaller period), so every place from the
    run's first word on proposes q until L + q words are left: the extent is exact.  Other levels give the same run
    again or nothing.  A level keeps only the names that occur twice, so memory is a few numbers per word.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not found at every level")
    at = np.arange(len(ids))
    name = ids.astype(np.int64)
    size, found = 1, []
    longest = int(np.diff(np.concatenate(([0], np.unique(ends)))).max()) if len(ids) else 0
    while size <= max(1, 2 * (longest // exponent)) and len(at):
        order = np.argsort(name, kind="stable")
        spot, group = at[order], name[order]
        twin = group[1:] == group[:-1]
        again = np.flatnonzero(twin)
        gap = spot[again + 1] - spot[again]
        near = (gap <= size) & (ends[spot[again]] == ends[spot[again + 1]])
        start, d = spot[again][near], gap[near]
        if len(start):
            by = np.lexsort((start, d))
            start, d = start[by], d[by]
            cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(d) != 0))
            first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(start) - 1]))
            found.append(np.stack([start[first], start[last] + size + 2 * d[last] - start[first] - d[last], d[first]]))
        # names of twice the length, only where both halves occur more than once
        shared = np.zeros(len(order), dtype=bool)
        shared[again] = shared[again + 1] = True
        label = np.concatenate(([0], np.cumsum(~twin))) if len(order) else np.zeros(0, dtype=np.int64)
        named = np.full(len(ids), -1, dtype=np.int64)
        named[spot[shared]] = label[shared]
        at = np.flatnonzero(named >= 0)
        at = at[at + 2 * size <= ends[at]]
        at = at[named[at + size] >= 0]
        name = named[at] * (len(ids) + 1) + named[at + size]
        size *= 2
    start, length, period = np.unique(np.concatenate(found or [np.zeros((3, 0), dtype=np.int64)], axis=1), axis=1)
    ok = length >= np.maximum(least, exponent * period)
    return start[ok], length[ok], period[ok]


def _work(texts: list[bytes], exponent: int, least: int) -> Iterator[tuple[int, list[dict[str, int]], str]]:
    """Per text the number of words, its runs by start and period, and the collapsed text."""
    split = [t.split() for t in texts]  # bytes split at the six ASCII blanks only
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in split for w in ws], dtype=np.int64)
    sizes = np.array([len(ws) for ws in split], dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    start, length, period = find_runs(ids, np.repeat(upto[1:], sizes), exponent, least)
    lo, hi = np.searchsorted(start, upto[:-1]), np.searchsorted(start, upto[1:])
    for ws, text, offset, a, b in zip(split, texts, upto[:-1].tolist(), lo.tolist(), hi.tolist()):
        if a == b:
            yield len(ws), [], b" ".join(ws)
            continue
        own = [{"start": s - offset, "length": n, "period": p}
               for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())]
        cover = np.zeros(len(ws) + 1, dtype=np.int64)
        np.add.at(cover, start[a:b] - offset + period[a:b], 1)
        np.add.at(cover, start[a:b] - offset + length[a:b], -1)
        keep = np.cumsum(cover[:-1]) == 0
        yield len(ws), own, b" ".join([w for w, k in zip(ws, keep.tolist()) if k])


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text.

    A run is a stretch of words with smallest period q, at least ``exponent`` (three or more) times q and ``least`` words long, that cannot be extended
    with period q.  ``runs`` lists them by start, then period.  ``collapsed`` holds the words no run
    covers after its first q words, joined by single blanks.

    Missing, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows stay rows of their
    own; other columns are not read.  No row leaves its partition, so copies and hot sources cost nothing extra.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
            [(k, pa.int64()) for k in ("start", "length", "period")]))), ("collapsed", pa.string())])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            upto = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            s = 0
            while s < len(texts):
                e = max(s + 1, int(np.searchsorted(upto, upto[s] + CHUNK, side="right")) - 1)
                done = list(_work(texts[s:e], exponent, least))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[s:e], pa.int64()), pa.array([n for n, _, _ in done], pa.int64()),
                    pa.array([r for _, r, _ in done], kinds.field("runs").type),
                    pa.array([c for _, _, c in done], pa.binary()).cast(pa.string())], schema=kinds)
                s = e

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document, by its id's checksum, loops: from some word on it repeats a stretch of itself."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    own = docs.select("doc_id", "text", F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)).alias("loops"), g.alias("g"))
    own = own.withColumn("words", F.when(F.col("loops"), words("text")))
    n = F.size("words")
    own = own.withColumn("a", F.when(F.col("loops") & (n > 0), F.pmod("g", n)))
    own = own.withColumn("p", F.when(F.col("a").isNotNull(), (1 + F.floor((n - F.col("a")) / (3 + F.pmod(F.col("g"), F.lit(8)))))))

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))

    looped = F.array_join(F.transform("words", word), " ")
    return own.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))
