"""Hard negatives, token counts and periodic runs against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspark.llm import negatives, runs, tokens
from gridspark.llm.queries import QUERIES, WORD_MODEL

FOLDER = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def cells(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANK:
            out, word = out + [word] if word else out, ""
        else:
            word += c
    return out + [word] if word else out


# --- hard negatives -------------------------------------------------------------------------------------------


def plain_negatives(rows, anchor, k=5, most=10):
    own = []
    for i, label, v in {(r[0], r[1], None if r[2] is None else tuple(r[2])) for r in rows}:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for i, label, v in own:
        if not anchor(i):
            continue
        met = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in own if len(w) == len(v) and j != i)
        for s, j, _ in [m for m in met if m[2] == label][:k]:
            hard = [m for m in met if m[2] != label and 30 * -s <= 100 * -m[0] <= 90 * -s][:most]
            out += [(i, j, n + 1, m[1], -s, -m[0]) for n, m in enumerate(hard)]
    return sorted(out)


KINDS = "vec_id long, label int, embedding array<double>, rows1 string, part string, score int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", "y", 0) for i, label, v in rows], KINDS)


@pytest.mark.parametrize("dims,size", [(1, 40), (5, 200), (64, 300)])
def test_negatives_are_those_of_all_pairs(spark, dims, size):
    rng = np.random.default_rng(dims)
    rows = [(i, int(rng.integers(0, 3)), np.round(rng.normal(0, 1, dims), 1).tolist()) for i in range(size)]
    rows += [(size + i, 1, rows[0][2]) for i in range(60)]          # one vector that is very common: ties by id
    rows += [rows[3], rows[3], (size + 100, None, rows[1][2]), (size + 200, 1, None), (size + 300, 1, []), (size + 400, 2, [None] * dims),
             (size + 500, 2, [float("nan")] * dims), (size + 600, 2, [float("inf")] * dims), (size + 700, 0, [1.0] * (dims + 1)),
             (None, 1, rows[0][2]), (size + 800, 1, [0.0] * dims)]
    got = negatives.mine(_vectors(spark, rows), anchor="vec_id % 5 = 0", block=64 * dims)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_of_large_components(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, (rng.integers(1, 9, 4) * 200003.37).tolist()) for i in range(40)] + [(99, 0, [1e300] * 4)]
    got = negatives.mine(_vectors(spark, rows), anchor="vec_id % 5 = 0")
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows[:-1], lambda i: i % 5 == 0)


def test_negatives_of_nothing(spark):
    assert negatives.mine(_vectors(spark, [])).collect() == []
    assert negatives.mine(_vectors(spark, [(1, 1, [1.0])])).collect() == []
    assert negatives.mine(_vectors(spark, [(100, 1, [1.0]), (2, 1, [1.0])])).collect() == []


def test_bounds_hold_and_refining_narrows_them():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-300, 300, (50, 23)) for _ in range(2))
    one, two = negatives.Summaries(a, (16, 8, 2)), negatives.Summaries(b, (16, 8, 2))
    exact, before = a @ b.T, None
    for level in range(3):
        low, high = negatives.bounds(one, two, level, slice(0, 50))
        assert (low <= exact).all() and (exact <= high).all()
        assert before is None or (high - low <= before + 1e-6).all()
        before = high - low
    i, j = np.nonzero(np.ones((50, 50)))
    assert (negatives.scores(one, two, i, j) == exact[i, j]).all()
    same = negatives.Summaries(np.repeat([[3], [5]], 16, axis=1), (16,))   # without deviation the bound is the product
    low, high = negatives.bounds(same, same, 0, slice(0, 2))
    assert np.allclose(low, [[144, 240], [240, 400]]) and np.allclose(high, low, atol=1e-4)


# --- token counts ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def merges():
    return tokens.load(WORD_MODEL)


def test_whole_words_are_one_token_by_the_library(merges):
    lib = Tokenizer.from_file(WORD_MODEL)
    some = random.Random(1).sample(merges.whole, 5000)
    met = [w for w, p in zip(some, map(tokens.Splitter(merges), some)) if p == [w]]
    assert len(merges.whole) > 20000 and len(met) > 4000
    assert {len(e.ids) for e in lib.encode_batch(met, add_special_tokens=False)} == {1}


def test_counts_are_those_of_the_library(spark, merges):
    lib = Tokenizer.from_file(WORD_MODEL)
    rng = random.Random(2)
    pool = ["the", "The", "über", "ÉCOLE", "ΟΔΟΣ", "İ", "日本語", "हिन्दी", "é", "́", "\x00", "\x1c", "\x85", "　", "꟎", "'s", "'LL", "don't",
            "<|endoftext|>", "<|startoftext|", "|>", "123", "½", "😀👩‍👩‍👧", "--", "_", " ", "  ", "\n", "ab" * 120, "zq", "퟿", "\U0003ffff"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))) for _ in range(600)] + ["", None, "x" * 70001, "word " * 30000]
    docs = spark.createDataFrame([(i, t, 0, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs, WORD_MODEL).collect()}
    want = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, want))}


def test_tokens_of_all_documents(spark):
    lib = Tokenizer.from_file(WORD_MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = [len(e.ids) for e in lib.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)]
    rows = QUERIES["op12_tokens"](spark, "/root/testdata/sf0.01").collect()
    assert {tuple(r) for r in rows} == {(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(docs, want)}
    assert len(rows) == len(docs)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.load("/opt/tokenizers/byte_bpe_50k.json")


def test_memory_of_words_is_bounded(merges, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 10)
    counts = tokens.Counts(merges)
    words = [f"zq{i}xk" for i in range(50)]
    assert [counts[w] for w in words] == [merges.count(w) for w in words] and len(counts) <= len(merges.whole) + 10


def test_long_words_merge_like_short_ones(merges):
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abeinotrsé") for _ in range(rng.randrange(1, 60)))
        data = word.encode()
        ids = [merges.inner[b] for b in data[:-1]] + [merges.final[data[-1]]]
        assert merges.count_long(ids) == merges.count(word)


# --- periodic runs --------------------------------------------------------------------------------------------


def plain_runs(w, exponent=4, least=6):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            seg = w[i:j + q]
            if len(seg) >= max(least, exponent * q) and not any(seg[p:] == seg[:-p] for p in range(1, q)):
                out.append((i, len(seg), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def _texts(rng, count):
    for _ in range(count):
        letters = rng.choice([1, 2, 3, 5, 30])
        w = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            p = [f"w{rng.randrange(letters + 1)}" for _ in range(rng.randrange(1, 12))]
            w = w[:10] + p * rng.randrange(1, 9) + p[:rng.randrange(len(p))] + w[10:]
        yield rng.choice([" ", "\n", " \t", "\x0b\r"]).join(w * rng.choice([1, 1, 1, 5]))


def test_runs_are_those_of_all_periods(spark):
    texts = [*_texts(random.Random(6), 800), "", None, " \n", "a", "é b " * 9, "  " * 7]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, runs string, start int")
    got = {r["doc_id"]: r for r in runs.collapse_runs(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = cells(t)
        found = plain_runs(w)
        assert [tuple(r) for r in got[i]["runs"]] == found and got[i]["n_words"] == len(w)
        assert got[i]["collapsed"] == plain_collapsed(w, found)


def test_runs_of_very_long_texts(spark):
    rng = random.Random(8)
    noise = [f"n{rng.randrange(9)}" for _ in range(3000)]
    unit = [f"u{i}" for i in range(777)]
    text = " ".join(noise + unit * 4 + noise)
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b " * 300000)], "doc_id long, text string")
    got = sorted((r["doc_id"], [tuple(x) for x in r["runs"] if x["period"] != 1 or r["doc_id"] == 2]) for r in runs.collapse_runs(docs).collect())
    assert got[0] == got[1] and (3000, 3108, 777) in got[0][1]
    assert got[2] == (2, [(0, 600000, 2)])


def test_chunks_do_not_change_runs(monkeypatch):
    texts = [t.encode() for t in _texts(random.Random(9), 60)]
    together = list(runs._work(texts, 4, 6))
    assert together == [x for t in texts for x in runs._work([t], 4, 6)]


def test_runs_query(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_runs"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    hits = 0
    for doc in docs:
        w = looped(doc["doc_id"], cells(doc["text"]))
        # long texts: all periods of looped ones only, the others have no long period to find
        found = plain_runs(w) if len(w) <= 1500 else [tuple(r) for r in next(runs._work([" ".join(w).encode()], 4, 6))[1]]
        r = got[doc["doc_id"]]
        hits += bool(found)
        assert r["n_runs"] == len(found) and r["n_words"] == len(w)
        assert r["runs_sha256"] == digest("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == digest(plain_collapsed(w, found))
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == top
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
    assert hits > 5


def test_loops_of_odd_documents(spark):
    rows = [(i, t) for i in range(60) for t in ("", None, "one", "a b c d e f g h i j k")] + [(None, "a b c")]
    got = runs.with_loops(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), " ".join(cells(r[1]))) for r in got) == sorted(
        (str(i), " ".join(cells(t) if i is None else looped(i, cells(t)))) for i, t in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(none, WORD_MODEL).count() == runs.collapse_runs(none).count() == 0
    assert runs.with_loops(none).where(F.col("text").isNotNull()).count() == 0
