"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import staged

TOKEN = re.compile(r"[^\W\d_]+")
SPANS = "array<struct<start:int,end:int,score:double,e_value:double>>"


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]   # of the tokens of the sample that are clearly on one side
    other: float                # weight of any other token
    rate: float                 # lambda and K of the extreme-value law
    k: float
    slope: float                # calibration to a probability
    shift: float


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in linear time (Ruzzo and Tompa).

    Runs of one sign are merged first; only positive runs are walked.
    """
    if not len(scores):
        return []
    edges = np.flatnonzero(np.diff(scores > 0)) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(scores)]))
    sums = np.add.reduceat(scores, starts)
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum up to its end, last lower one
    total = 0.0
    for s, e, x in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if x <= 0:
            total += x
            continue
        start, left, total = s, total, total + x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:  # the nearest segment that began lower
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, e, left, total, j))
    return [(s, e, r - l) for s, e, l, r, _ in found]


def _scores(text: str, model: Model) -> np.ndarray:
    get, other = model.weights.get, model.other
    return np.array([get(w, other) for w in TOKEN.findall(text.lower())], dtype=np.float64)


def _statistic(best: float, n: int, model: Model) -> float:
    """Minus the natural logarithm of the expected number of segments this good among ``n`` tokens by chance."""
    return model.rate * best - math.log(model.k * max(n, 1))


def _combined(found: list[float], n: int, model: Model) -> float:
    """Minus the natural logarithm of the chance that the r best of ``n`` tokens' segments sum up this high, for the r that is least likely.

    The sum T of r normalised scores exceeds x with probability exp(-x) x^(r-1) / (r! (r-1)!) for large x (Karlin and Altschul).
    Each further segment costs a factor of two, as r is chosen afterwards.  One segment gives its own statistic.
    """
    if not found:
        return _statistic(0.0, n, model)
    best, total = _statistic(max(found), n, model), 0.0
    for r, x in enumerate(sorted(found, reverse=True), 1):
        more = _statistic(x, n, model)
        total += more
        if more <= 0:
            break
        if r > 1 and total > r:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


def _scale(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1; scores must be negative on average."""
    low, high = 1e-6, 1.0
    while float(np.dot(shares, np.exp(np.minimum(high * values, 700)))) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(np.dot(shares, np.exp(np.minimum(mid * values, 700)))) < 1 else (low, mid)
    return (low + high) / 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, strength: float = 100.0,
          least_z: float = 3.0, drift: float = 0.05) -> Model:
    """Fit on at most ``max_rows`` labelled documents, chosen by a hash of their id.

    ``labels`` has ``doc_id`` and ``toxic``; rows without either, and labels of ids no document has, are left out, and a document is toxic if any row
    says so.  Of rows that share an id the smallest text is read, so ``max_rows`` bounds the sample however often an id is
    repeated.  A token counts once per document, so no single text makes it toxic.  Log-odds of its share of
    the toxic and of the other documents carry a Dirichlet prior: half a count for every token, and ``strength`` counts in the proportions of both
    together.  Tokens within ``least_z`` standard errors of zero weigh nothing; all others of the sample are kept.
    Every token loses ``drift``, so that chance passages lose on average.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").distinct().join(marks, "doc_id")
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "toxicity_labels")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = staged(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "toxicity_sample")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counts = rows.select("toxic", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("c"))
    both = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n_t, n_c = float(both["t"] or 0), float(both["c"] or 0)
    prior = 0.5 + F.lit(strength) * (F.col("t") + F.col("c")) / F.lit(max(n_t + n_c, 1.0))
    docs_t, docs_c = (float(n or 0) for n in rows.agg(F.sum((F.col("toxic") > 0).cast("int")), F.sum((F.col("toxic") <= 0).cast("int"))).first())
    odds = lambda x, n: F.log((F.col(x) + prior) / F.lit(n + 1.0))
    error = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    clear = (counts.withColumn("w", odds("t", docs_t) - odds("c", docs_c)).withColumn("z", F.abs("w") / error)
             .where((F.col("z") >= least_z) & F.col("w").isNotNull())
             .select("token", "w", "c").orderBy("token").collect())  # some of the sample's tokens
    weights = {r["token"]: r["w"] - drift for r in clear}
    values = np.array([*(r["w"] - drift for r in clear), -drift])
    shares = np.array([*(float(r["c"]) for r in clear), max(n_c - sum(r["c"] for r in clear), 1.0)])
    rate = _scale(values, shares / shares.sum())
    bare = Model(weights, -drift, rate, 1.0, 1.0, 0.0)
    seen = best_segments(rows, bare, keep=("toxic",)).select("toxic", "n_tokens", "best").toPandas()  # max_rows at most
    clean = seen[(seen.toxic == 0) & (seen.n_tokens > 0)]
    # for the Gumbel law the mean of exp(-(rate * best - ln n)) over documents is 1 / K
    k = 1.0 / max(float(np.mean(np.exp(-(rate * clean.best - np.log(clean.n_tokens))))), 1e-9) if len(clean) else 1.0
    model = Model(weights, -drift, rate, k, 1.0, 0.0)
    seen = best_segments(rows, model, keep=("toxic",)).select("toxic", "statistic").toPandas()
    x = seen.statistic.to_numpy()
    slope, shift = _logistic(x, (seen.toxic > 0).to_numpy(dtype=float))
    return Model(weights, -drift, rate, k, slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton's method with a small ridge; the slope never falls below zero."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    mean, dev = float(x.mean()), float(x.std()) or 1.0
    a, b, u = 0.0, 0.0, (x - mean) / dev
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -35, 35)))
        w = p * (1 - p)
        g = np.array([np.dot(p - y, u) + a * 0.1, np.sum(p - y) + b * 0.01])
        h = np.array([[np.dot(w, u * u) + 0.1, np.dot(w, u)], [np.dot(w, u), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    a = max(a, 1e-6)
    return a / dev, b - a * mean / dev


def best_segments(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), significant: float = 0.01) -> DataFrame:
    """Per document the columns ``keep``, ``n_tokens``, ``best``, ``statistic``, ``score`` and ``passages``.

    The whole text is scanned.  ``passages`` holds every maximal segment whose expected number by chance is at most
    ``significant``, with character positions.  ``score`` rises with the statistic of the best segments together; a text
    without tokens, or a missing one, has no segment and ``best`` 0.
    """
    import pyarrow as pa

    fields = ["n_tokens", "best", "statistic", "score", "passages"]

    def scan(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                scores = _scores(text, model)
                found = segments(scores) if len(scores) and scores.max() > 0 else []
                best = max((x for _, _, x in found), default=0.0)
                stat = _combined([x for _, _, x in found], len(scores), model)
                limit = math.log(1 / significant)
                sure = [(s, e, x) for s, e, x in found if _statistic(x, len(scores), model) >= limit]
                spots = [m.span() for m in TOKEN.finditer(text.lower())] if sure else []
                out.append((len(scores), best, stat, 1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * stat + model.shift)))),
                            [{"start": spots[s][0], "end": spots[e - 1][1], "score": x,
                              "e_value": math.exp(-_statistic(x, len(scores), model))} for s, e, x in sure]))
            cols = list(zip(*out)) or [()] * len(fields)
            types = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, cols, types)], names=["row", *fields])

    picked = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    kind = picked.schema["row"].dataType.simpleString()
    found = picked.mapInArrow(scan, f"row {kind}, n_tokens int, best double, statistic double, score double, passages {SPANS}")
    return found.select("row.*", *[f for f in fields if f not in keep])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label is learnt from: crc32 of the id as text leaves 1 on division by 3; a missing id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
