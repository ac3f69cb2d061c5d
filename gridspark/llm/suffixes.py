"""Repeated passages by two-stage suffix sorting, removed from all documents but the first.

How the pieces fit together: every window of ``width`` bytes picks the smallest of its byte grams as its anchor.
Windows side by side that pick the same one form a segment.  Equal windows have equal anchors at equal places, so only
segments under the same anchor need comparing.  Segments that are equal as a whole are settled by
their order.  Where an anchor has different segments, one of each is sorted by suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import partitions, staged

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20     # bytes hashed at a time
LAST_ID = (1 << 63) - 1
BUCKETS = 1 << 16   # of anchors, to find hot ones
HOT_ROWS = 1000     # a bucket is hot beyond so many rows
HOT_SHARE = 4       # and beyond one part in so many of an even partition


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Hasher:
    """Hashes of any substring of a chunk, from sums of bytes times powers modulo 2^64."""

    def __init__(self, most: int):
        self.up = _powers(BASE, most + 1)
        self.down = _powers(pow(BASE, -1, 1 << 64), most + 1)

    def read(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * self.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    return h * U(0x94D049BB133111EB)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, x
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:len(x) - width + 1], low[width - size:]) if width > size else low


def segment(hasher: Hasher, data: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of a chunk of documents that lie side by side, document d in ``bounds[d]:bounds[d + 1]``.

    ``first``, ``last``: the windows of a segment; ``anchor``: its gram's place; ``doc``, and ``h``, the gram's hash.
    Equal grams in a window count as the leftmost, so the anchor depends on the window's bytes alone.
    """
    none = np.empty(0, dtype=np.int64)
    if len(data) < width:
        return {"first": none, "last": none, "anchor": none, "doc": none, "h": none.astype(U)}
    hasher.read(data)
    n = len(data) - gram + 1
    h = hasher.of(slice(0, n), slice(gram, gram + n))
    low = sliding_min((h & ~U((1 << 24) - 1)) | np.arange(n, dtype=U), width - gram + 1)
    at = (low & U((1 << 24) - 1)).astype(np.int64)
    flag = np.zeros(len(data) + 1, dtype=np.int32)
    long = np.diff(bounds) >= width
    flag[bounds[:-1][long]] += 1
    flag[bounds[1:][long] - width + 1] -= 1
    valid = np.cumsum(flag)[:len(at)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    over = valid.copy()
    over[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(over)
    return {"first": first, "last": last, "anchor": at[first], "h": h[at[first]],
            "doc": np.searchsorted(bounds, first, side="right") - 1}


def chunks(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut documents into chunks: ``(from, to, bounds, document numbers)``; a long one overlaps itself by a window."""
    d, n = 0, len(offsets) - 1
    while d < n:
        size = offsets[d + 1] - offsets[d]
        if size > CHUNK:
            for s in range(int(offsets[d]), int(offsets[d + 1]) - width + 1, CHUNK - width + 1):
                e = min(s + CHUNK, int(offsets[d + 1]))
                yield s, e, np.array([0, e - s]), np.array([d])
            d += 1
            continue
        e = int(np.searchsorted(offsets, offsets[d] + CHUNK, side="right")) - 1
        yield int(offsets[d]), int(offsets[e]), offsets[d:e + 1] - offsets[d], np.arange(d, e)
        d = e


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that follows; the last counts as larger."""
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.append(change, len(t) - 1)  # last place of each run of a symbol
    rises = np.append(t[change + 1] > t[change], False)
    return np.repeat(rises, np.diff(np.concatenate(([-1], ends))))


def sort_suffixes(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` in the order of their first ``depth`` symbols, in two stages.

    Suffixes smaller than their successor are sorted directly, eight symbols at a time and only while they tie.  The rest
    follows by one scan over the buckets of first symbols: the suffix before each one met, if it is larger than its
    successor, is next in the bucket of its own first symbol.
    """
    n = len(t)
    small = smaller_than_next(t)
    padded = np.concatenate((t, np.zeros(depth + 8, dtype=np.uint8)))
    word = np.zeros(n + depth, dtype=U)
    for k in range(8):
        word = (word << U(8)) | padded[k:k + n + depth].astype(U)
    order = np.flatnonzero(small)
    order = order[np.argsort(word[order], kind="stable")]
    tie = np.zeros(len(order), dtype=bool)  # equal to the one before so far
    tie[1:] = word[order[1:]] == word[order[:-1]]
    for k in range(8, depth, 8):
        busy = tie.copy()
        busy[:-1] |= tie[1:]
        where = np.flatnonzero(busy)
        if not len(where):
            break
        own, group = order[where], np.cumsum(~tie[where])
        key = word[own + k]
        into = np.lexsort((key, group))
        order[where] = own = own[into]
        key, group = key[into], group[into]
        same = np.zeros(len(where), dtype=bool)
        same[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        tie[where] = same
    sharp = np.searchsorted(t[order], np.arange(257))  # bucket bounds among the sorted ones
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[t[-1]].append(np.array([n - 1]))  # met first: what follows it is empty
    out = []
    for c in range(256):
        wave = np.concatenate(larger[c]) if larger[c] else np.empty(0, dtype=np.int64)
        front = [wave]
        while len(wave):  # runs of c: each is induced by its neighbour within the bucket
            wave = wave[wave > 0] - 1
            wave = wave[(t[wave] == c) & ~small[wave]]
            front.append(wave)
        bucket = np.concatenate([*front, order[sharp[c]:sharp[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        if len(before):
            symbol = t[before]
            sort = np.argsort(symbol, kind="stable")
            before, symbol = before[sort], symbol[sort]
            cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
            for part in np.split(before, cuts):
                larger[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of suffixes with their predecessors in ``order``, counted up to ``most``; the first has none.  The end counts as a zero."""
    padded = np.concatenate((t, np.zeros(most + 8, dtype=np.uint8)))
    found = np.zeros(len(order), dtype=np.int64)
    busy = np.arange(1, len(order))
    for k in range(most):
        busy = busy[padded[order[busy] + k] == padded[order[busy - 1] + k]]
        if not len(busy):
            break
        found[busy] = k + 1
    return found


def repeated_windows(texts: list[bytes], place: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """Runs of windows that also start earlier: ``(text, first, last)``; ``place`` orders the first bytes of the texts in the corpus."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    # UTF-8 has no byte above 0xF4, so bytes move up by one and zero separates
    t = np.zeros(int((sizes + 1).sum()) + 1, dtype=np.uint8)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8) + np.uint8(1)
    t[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)] = flat
    order = sort_suffixes(t, width)
    owner = np.searchsorted(starts, order, side="right") - 1
    full = order - starts[owner] + width <= sizes[owner]
    order, owner = order[full], owner[full]
    if not len(order):
        return
    head = common_prefixes(t, order, width) < width
    head[0] = True
    when = place[owner] + (order - starts[owner])
    first = np.repeat(np.minimum.reduceat(when, np.flatnonzero(head)), np.diff(np.append(np.flatnonzero(head), len(head))))
    gone = np.sort(order[when > first])
    if not len(gone):
        return
    cut = np.flatnonzero(np.diff(gone) != 1) + 1
    for run in np.split(gone, cut):
        i = int(np.searchsorted(starts, run[0], side="right") - 1)
        yield i, int(run[0] - starts[i]), int(run[-1] - starts[i])


ROWS = "h long, ctx long, doc long, tie long, place long"


def _batch(kind, h, ctx, doc, tie, start, span):
    """Rows of segments (``kind`` 1) or of spans to remove (0); kind, start and span share one number, since these rows are most of what is shuffled."""
    import pyarrow as pa

    n = len(doc)
    fill = lambda x: pa.array(np.broadcast_to(np.asarray(x), n).astype(np.int64))
    place = np.asarray(start).astype(U) << U(33) | np.asarray(span).astype(U) << U(1) | U(kind)
    return pa.RecordBatch.from_arrays([fill(h), fill(ctx), fill(doc), fill(tie), fill(place.view(np.int64))],
                                      names=["h", "ctx", "doc", "tie", "place"])


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``kind, start, span`` of rows made by ``_batch``; no text reaches 2^31 bytes."""
    place = place.view(U)
    return (place & U(1)).astype(np.int64), (place >> U(33)).astype(np.int64), (place >> U(1) & U((1 << 32) - 1)).astype(np.int64)


#: The same for columns.
IS_SEGMENT = "(place & 1) = 1"
START = "shiftrightunsigned(place, 33)"
SPAN = "shiftrightunsigned(place, 1) & 4294967295"


def _spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, span: np.ndarray):
    """Merge touching spans of the same document."""
    o = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[o], tie[o], start[o], (start + span)[o]
    new = np.ones(len(o), dtype=bool)
    other = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    # ends never fall back within a document if each is at least the largest before it
    block = np.concatenate(([0], np.cumsum(other)))
    reach = np.maximum.accumulate(end + block * (1 << 40)) - block * (1 << 40)
    new[1:] = other | (start[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(o)) - 1
    return doc[heads], tie[heads], start[heads], (reach[tails] - start[heads])


def _classes(h, ctx, doc, tie, start):
    """Order rows by (h, ctx, place); which begin a new h, which a new (h, ctx), and which stand at the first place of theirs."""
    o = np.lexsort((start, tie, doc, ctx, h))
    h, ctx, doc, tie, start = h[o], ctx[o], doc[o], tie[o], start[o]
    new_h = np.ones(len(o), dtype=bool)
    new_h[1:] = h[1:] != h[:-1]
    new = new_h.copy()
    new[1:] |= ctx[1:] != ctx[:-1]
    lead = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(o))))
    first = (doc == doc[lead]) & (tie == tie[lead]) & (start == start[lead])
    return o, new_h, new, first


def _ranks(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    o = np.lexsort((tie, doc))
    new = np.zeros(len(o), dtype=np.int64)
    new[1:] = (doc[o][1:] != doc[o][:-1]) | (tie[o][1:] != tie[o][:-1])
    rank = np.empty(len(o), dtype=np.int64)
    rank[o] = np.cumsum(new)
    return rank


def _complete(batches: Iterator, column: str = "h", least: int = 200_000, weigh: Callable | None = None) -> Iterator:
    """Tables cut where ``column``, by which rows are sorted, changes."""
    import pyarrow as pa

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += weigh(batch) if weigh else batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table[column].to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1])
        if not len(change):
            continue
        cut = int(change[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        count = sum(map(weigh, held)) if weigh else table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _pieces(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the asked pieces, rows ``doc, tie, h, start, piece, others``; rows repeated as a whole count as one document and give each piece once.

    ``others`` stands for the columns the pieces don't need: with them, this join shuffles what the last join of ``with_spans`` shuffles,
    so Spark does it once for both.  Repeats are dropped where the join has put them, without a further shuffle.
    """
    cut = F.transform("asked", lambda a: F.struct(
        a["h"].alias("h"), a["start"].alias("start"), F.substring(F.col("data"), a["start"].cast("int") + 1, a["span"].cast("int")).alias("piece")))
    met = docs.join(asked, ["doc", "tie"]).select("doc", "tie", F.xxhash64("row").alias("others"), F.inline(cut))
    return met.dropDuplicates(["doc", "tie", "h", "start"])


def find_repeats(docs: DataFrame, width: int = 100, gram: int = 32, block: int = 1 << 20) -> DataFrame:
    """Spans ``doc, tie, start, span`` that windows of ``width`` bytes which also start earlier cover; spans of a document may overlap.

    ``docs`` is made by ``keyed``.  Copies within a task are settled there.  Anchors in a
    hot bucket (more rows than a quarter of an even partition, so at most four per partition) are dealt out window by
    window, whatever number of segments they have; so no task meets a group that grows with the corpus.
    """
    import pyarrow as pa

    rows = docs.select("doc", "tie", "data").where(F.octet_length("data") >= width)

    def segments(batch, hasher):
        if not batch.num_rows:
            return
        column = batch.column("data")
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        for s, e, bounds, number in chunks(offsets, width):
            found = segment(hasher, data[s:e], bounds, width, gram)
            if len(found["first"]):
                yield found, s - offsets[number[found["doc"]]], number[found["doc"]]

    def count(batches: Iterator) -> Iterator:
        hasher, total = Hasher(CHUNK), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for found, _, _ in segments(batch, hasher):
                total += np.bincount((found["h"] >> U(48)).astype(np.int64), minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    deal = partitions(docs)
    sums = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    limit = max(HOT_ROWS, sum(r["n"] for r in sums) // (HOT_SHARE * deal))
    hot = np.array(sorted(r["bucket"] for r in sums if r["n"] > limit), dtype=np.int64)

    def place(batches: Iterator) -> Iterator:
        hasher = Hasher(CHUNK)
        for batch in batches:
            parts = []
            for found, shift, number in segments(batch, hasher):
                first, last, anchor, h = found["first"], found["last"], found["anchor"], found["h"]
                hit = np.isin((h >> U(48)).astype(np.int64), hot)
                n = (last - first + 1)[hit]
                at = np.repeat(first[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                own = np.flatnonzero(~hit)
                ctx = hasher.of(first[own], last[own] + width) ^ mixed((anchor - first)[own].astype(U) << U(16) | (last - first)[own].astype(U))
                parts.append((h[own].view(np.int64), ctx.view(np.int64), number[own], (first + shift)[own], (last - first)[own] + width))
                back = np.repeat(np.flatnonzero(hit), n)
                parts.append((hasher.of(at, at + width).view(np.int64), (h[back] + (anchor[back] - at).astype(U)).view(np.int64),
                              number[back], at + shift[back], np.full(len(at), width)))
            if not parts:
                continue
            h, ctx, number, start, span = (np.concatenate(x) for x in zip(*parts))
            doc, tie = batch.column("doc").to_numpy()[number], batch.column("tie").to_numpy()[number]
            o, _, new, first = _classes(h, ctx, doc, tie, start)
            keep, gone = o[new], o[~first]
            yield _batch(1, h[keep], ctx[keep], doc[keep], tie[keep], start[keep], span[keep])
            if len(gone):
                d, t, s, n = _spans(doc[gone], tie[gone], start[gone], span[gone])
                yield _batch(0, mixed(s.astype(U) + t.view(U)).view(np.int64), 0, d, t, s, n)

    def settle(batches: Iterator) -> Iterator:
        for table in _complete(batches):
            h, ctx, doc, tie, place = (table[c].to_numpy() for c in ("h", "ctx", "doc", "tie", "place"))
            kind, start, span = _unpacked(place)
            done = kind == 0
            yield _batch(0, 0, 0, doc[done], tie[done], start[done], span[done])
            h, ctx, doc, tie, start, span = (x[~done] for x in (h, ctx, doc, tie, start, span))
            if not len(h):
                continue
            o, new_h, new, first = _classes(h, ctx, doc, tie, start)
            gone = o[~first]
            yield _batch(0, 0, 0, doc[gone], tie[gone], start[gone], span[gone])
            group = np.cumsum(new_h) - 1
            many = np.bincount(group, new) > 1
            ask = o[new & many[group]]
            yield _batch(1, h[ask], 0, doc[ask], tie[ask], start[ask], span[ask])

    dealt = rows.mapInArrow(place, ROWS).repartition(deal, "h").sortWithinPartitions("h")
    settled = staged(dealt.mapInArrow(settle, ROWS).drop("ctx"), "repeat_rows")

    asked = settled.where(IS_SEGMENT).groupBy("doc", "tie").agg(F.collect_list(
        F.struct("h", F.expr(START).alias("start"), F.expr(SPAN).alias("span"))).alias("asked"))
    pieces = _pieces(docs, asked)
    pieces = pieces.repartition(deal, "h").sortWithinPartitions("h")

    def compare(batches: Iterator) -> Iterator:
        for table in _complete(batches, least=block, weigh=lambda b: b.column("piece").nbytes):
            doc, tie, start = (table[c].to_numpy() for c in ("doc", "tie", "start"))
            rank = _ranks(doc, tie)
            runs = list(repeated_windows(table["piece"].to_pylist(), (rank << 40) + start, width))
            if runs:
                i, a, b = (np.array(x, dtype=np.int64) for x in zip(*runs))
                yield _batch(0, 0, 0, doc[i], tie[i], start[i] + a, b - a + width)

    late = pieces.mapInArrow(compare, ROWS)
    out = ["doc", "tie", F.expr(START).alias("start"), F.expr(SPAN).alias("span")]
    return settled.where(f"NOT {IS_SEGMENT}").select(*out).unionByName(late.select(*out))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows ``doc, tie, data, row``: the id (a missing one is the largest), a hash of the text, its UTF-8 bytes (a missing text
    has none), and all other columns, so that their names don't matter."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("tie"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
        F.struct(*others, F.col("text").isNotNull().alias("_has_text")).alias("row"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["start"] + x["span"]) for x in (spans if spans is not None else ())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)]))


def with_spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """Rows ``row, data, spans``: a document, its bytes, and what is to be removed from it.

    A byte goes if a window of ``width`` bytes that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one.  Windows do not cross documents, and all are judged on the input.  Missing texts are empty.
    Rows that agree in id and text are one document, shown as often; rows that agree in the id alone are ordered by a hash of their texts.
    """
    rows = keyed(docs)
    spans = find_repeats(rows, width).groupBy("doc", "tie").agg(
        F.collect_list(F.struct("start", "span")).alias("spans"))  # no more than the document has windows
    return rows.join(spans, ["doc", "tie"], "left").select("row", "data", "spans")


def removal_report(docs: DataFrame, width: int = 100) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans`` (touching spans are one) and ``kept_sha256``."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                cut = _merged(spans)
                out.append((len(data), sum(e - s for s, e in cut), len(cut), hashlib.sha256(_without(data, cut)).hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").field("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return own.mapInArrow(  # the row goes whole, as its fields would be cut out below the shuffle
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """``docs`` with shorter texts: what repeats is cut out, and with it the rest of a character that was cut through.

    All columns stay; a missing text stays missing.
    """
    import pyarrow as pa

    spans = with_spans(docs, width)
    kind = spans.schema["row"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts = [_without(d, _merged(s)).decode("utf-8", "ignore") for d, s in zip(
                batch.column("data").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    cut = spans.mapInArrow(run, f"row {kind}, text string")
    return cut.select(*[F.when(F.col("row._has_text"), F.col("text")).alias(c) if c == "text" else F.col("row")[c].alias(c)
                        for c in docs.columns])
