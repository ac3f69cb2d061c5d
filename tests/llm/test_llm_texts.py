"""Toxicity, licences, SimHash, suffixes, embeddings and pieces against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import licenses, pieces, simhash, suffixes, toxicity, vectors
from gridspark.llm.common import components
from gridspark.llm.queries import PIECE_MODEL

RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choice("abcdefghijé") for _ in range(RANDOM.randint(2, 9))) for _ in range(3000)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def brute_segments(scores):
    """All maximal segments by their definition: the best subsequence, then the same left and right of it."""
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best or (total == best and at and j - i < at[1] - at[0] - 1):
                best, at = total, (i, j + 1)
    if at is None:
        return []
    left = brute_segments(scores[:at[0]])
    right = [(s + at[1], e + at[1], x) for s, e, x in brute_segments(scores[at[1]:])]
    return [*left, (*at, best), *right]


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    r = random.Random(seed)
    scores = [r.choice([-3.0, -1.5, -0.5, 1.0, 2.25, 4.0]) + r.random() * 0.001 for _ in range(40)]
    got = toxicity.segments(np.array(scores))
    want = brute_segments(scores)
    assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]
    assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity(spark):
    clean = [(i, prose(120, i), 0) for i in range(300)]
    foul = [(1000 + i, prose(40, i) + " vile nasty brute " + prose(40, 99 + i) + " nasty vile", 1) for i in range(60)]
    docs = spark.createDataFrame([*((i, t) for i, t, _ in clean + foul), (None, None), (5000, ""), (5001, "12 34")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + foul if i % 2] + [(None, 1), (3, None), (1001, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.best_segments(docs, model).collect()
    assert len(rows) == 363 and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert all(score[i] >= 0.7 for i, _, _ in foul) and all(score[i] < 0.7 for i, _, _ in clean)
    row = next(r for r in rows if r["doc_id"] == 1000)
    text = dict((i, t) for i, t, _ in foul)[1000]
    assert any("vile nasty brute" in text[p["start"]:p["end"]] for p in row["passages"])
    assert toxicity.best_segments(docs.limit(0), model).count() == 0
    again = toxicity.train(docs.unionByName(docs.where("doc_id = 1001").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")), labels)
    assert again == model  # a repeated id is read once
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.best_segments(docs, nothing).collect())


def brute_licenses(text, templates, least):
    words, found = licenses.normalised(text), []
    grams = lambda w: list(zip(w, w[1:]))
    for k, t in enumerate(templates.values()):
        own = grams(licenses.normalised(t))
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 1 + int(len(own) * (2 - least) / least) + 1) + 1):
                window, left, both = grams(words[i:j]), list(own), 0
                for g in window:
                    if g in left:
                        left.remove(g)
                        both += 1
                dice = 2 * both / (len(window) + len(own))
                if dice >= least and window[0] in own and window[-1] in own:
                    found.append((-dice, i, j, k))
    taken, out = [], []
    for d, i, j, k in sorted(found):
        if all(j <= a + 1 or i >= b - 1 for a, b in taken):
            taken.append((i, j))
            out.append((list(templates)[k], round(-d, 9), i, j - i))
    return sorted(out, key=lambda x: x[2])


def test_licenses(spark):
    some = {k: licenses.TEMPLATES[k] for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0")}
    texts = [prose(30, 1) + "\nReleased under the MIT License.\n" + prose(9, 2), "licensed under the Apache Licence version 2.0", None, "", "MIT",
             "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0. " * 3, prose(400, 3),
             "This work is now licensed under the GNU General Public License version three 3"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), some).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["dice"], 9), r["start_word"], r["n_words"]))
    assert got == {i: x for i, t in enumerate(texts) if t and (x := brute_licenses(t, some, 0.8))}
    assert len(got[0]) == 1 and len(got[5]) == 6


CONFUSABLE = {
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "Licensed under CC BY 4.0.": "CC-BY-4.0-short",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0-long",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
    "distribution, and is available at": "EPL-1.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
}


@pytest.mark.parametrize("text, name", CONFUSABLE.items())
def test_license_relatives(text, name):
    got = licenses.Scanner(licenses.all_templates(), 0.8).matches(f"{prose(20, 1)} {text} {prose(20, 2)}")
    assert [(n, d) for n, d, *_ in got] == [(name, 1.0)]


def test_every_license_finds_itself():
    table = licenses.all_templates()
    scanner = licenses.Scanner(table, 0.8)
    for name, text in table.items():
        n = len(licenses.normalised(text))
        assert scanner.matches(f"{prose(20, 1)}\n{text}\n{prose(20, 2)}") == [(name, 1.0, 20, n)]
    assert set(licenses.FULL) <= {n.removesuffix("-text") for n in table if n.endswith("-text")}


def test_full_texts_with_changes():
    scanner = licenses.Scanner(licenses.all_templates(), 0.8)
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "GPL-2.0", "LGPL-2.1", "AGPL-3.0"):
        words = licenses.all_templates()[f"{name}-text"].split()
        for i in range(7, len(words), 40):
            words[i] = "other"
        assert [n for n, *_ in scanner.matches(" ".join(words))] == [f"{name}-text"]


def brute_components(n, near):
    low = list(range(n))
    for _ in range(n):
        new = [min([low[i], *(low[j] for j in range(n) if near(i, j))]) for i in range(n)]
        if new == low:
            return low
        low = new


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for t in ("", "One", "É Two\x0bthree", prose(300, 4), "A b\x85c d e f", None):
        assert simhash.fingerprint((t or "").encode()) == plain_print(t)


def test_links_follow_all_pairs(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    values = list({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(8)} | {0, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    near = lambda i, j: bin(values[i] ^ values[j]).count("1") <= 2
    order = sorted(range(len(values)), key=lambda i: signed[i])
    signed, values = [signed[i] for i in order], [values[i] for i in order]
    want = brute_components(len(values), near)
    for rows in (4096, 3):  # one tree per key, or several
        links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tree_rows=rows)
        got = {x["node"]: x["root"] for x in components(links).collect()}
        assert [got.get(v, v) for v in signed] == [signed[i] for i in want]


def test_simhash(spark):
    base = prose(400, 8)
    near = base.replace(base.split()[50], "other", 1)
    rows = [(7, base), (3, near), (9, base.upper().replace("É", "é")), (4, prose(300, 9)), (None, None), (11, ""), (12, " \n"), (13, base), (13, base), (14, prose(20000, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_print(t) for _, t in rows]
    comp = brute_components(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    ids = lambda c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted((str(d), f"{p:016x}", ids(c)) for (d, _), p, c in zip(rows, prints, comp))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.one_of_each(docs.limit(0)).count() == 0


def brute_removed(rows, width=100):
    """rows in order of place; rows equal in id and text are one document."""
    seen, out = {}, {}
    for key, data in rows:
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - width + 1):
            if seen.setdefault(data[i:i + width], (key, i)) != (key, i):
                gone[i:i + width] = True
        out[key] = gone
    return out


def report(data, gone):
    runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
    return len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()


def test_sort_suffixes():
    for seed in range(20):
        r = np.random.default_rng(seed)
        t = r.integers(1, r.integers(3, 60), r.integers(1, 400)).astype(np.uint8)
        if seed % 3 == 0:
            t = np.tile(t[:17], 20)
        raw = t.tobytes()
        got = suffixes.sort_suffixes(t, 100).tolist()
        assert sorted(got) == list(range(len(t)))
        heads = [raw[i:i + 100] for i in got]
        assert heads == sorted(heads)
        lcp = suffixes.common_prefixes(t, np.array(got), 30).tolist()
        assert lcp == [0, *(next((k for k in range(30) if a[k:k + 1] != b[k:k + 1] or not a[k:k + 1]), 30) for a, b in zip(heads, heads[1:]))]


@pytest.mark.parametrize("hot", [False, True])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "CHUNK", 5000)
    if hot:  # every anchor counts as hot
        monkeypatch.setattr(suffixes, "HOT_ROWS", 0)
        monkeypatch.setattr(suffixes, "HOT_SHARE", 10**9)
    passage = prose(40, 50)
    texts = [prose(200, 20), None, "", "short", prose(30, 21) + passage + prose(30, 22), passage, prose(20, 23) + passage + "é" + passage + prose(9, 24),
             "ab" * 300, "é" * 200, prose(1500, 25), "x" + prose(1500, 25)[700:6000], passage[:99], prose(200, 20), "ab" * 120 + passage[3:150]]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(50, texts[4]), (50, texts[4]), (60, "\x00" * 250 + passage[:130])]
    docs = spark.createDataFrame([*rows, (None, texts[0])], "doc_id long, text string").withColumns({"data": F.lit(1), "doc": F.lit("own"), "spans": F.lit(2)})
    placed = sorted({(d, (t or "").encode()) for d, t in rows}, key=lambda x: x[0]) + [(None, texts[0].encode())]
    gone = brute_removed(placed)
    data = dict(placed)
    want = sorted((str(d), *report(data[d], gone[d])) for d, _ in [*rows, (None, "")])
    got = suffixes.removal_report(docs.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    cut = suffixes.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    for r in cut.collect():
        if r["text"] is None:
            assert r["doc_id"] == 99
        else:
            assert r["text"] == bytes(np.frombuffer(data[r["doc_id"]], np.uint8)[~gone[r["doc_id"]]]).decode("utf-8", "ignore")
        assert (r["data"], r["doc"], r["spans"]) == (1, "own", 2)
    assert suffixes.removal_report(docs.limit(0)).count() == 0


def test_quantised_products_miss_nothing():
    r = np.random.default_rng(1)
    a = r.normal(size=(300, 40))
    b = np.concatenate([a[:100] + r.normal(size=(100, 40)) * 0.2, r.normal(size=(50, 40))])
    i, j = vectors.linked(a, b, 0.98)
    cos = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(cos >= 0.98)))) and len(i)
    wide = r.integers(-127, 128, (3, 2500)).astype(np.int8)
    assert (vectors.tile_product(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


def test_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 16)).astype(np.float32)
    rows = [(k, (base[k % 6] + r.normal(size=16) * 0.08).astype(np.float32).tolist(), k % 2) for k in range(60)]
    rows += [(100 + k, rows[0][1], 0) for k in range(5)] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[1][1], None), (204, [], 1),
             (205, [1.0, None], 1), (206, [float("inf"), 1.0], 1), (207, [1.0, 0.0], 1), (208, [2.0, 0.0], 1), (209, [2.0, -0.0], 1), (None, rows[1][1], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1))
    ok = lambda v, y: y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def near(i, j):
        (_, a, x), (_, b, y) = rows[i], rows[j]
        if i == j or not ok(a, x) or not ok(b, y) or x != y or len(a) != len(b):
            return False
        a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98

    comp = brute_components(len(rows), near)
    ids = lambda c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None)
    want = sorted((str(v), sum(near(i, j) for j in range(len(rows))), ids(comp[i]), ids(comp[i]) == v) for i, (v, *_) in enumerate(rows))
    for tile in (2048, 4):
        got = vectors.near_duplicates(docs, tile=tile).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert vectors.near_duplicates(docs.limit(0)).count() == 0


def test_pieces(spark, tmp_path):
    import sentencepiece

    raw = open(PIECE_MODEL, "rb").read()
    at = raw.rindex(b"\x06tok_v0\x18\x02")
    other = tmp_path / "unigram.model"  # the same pieces, with the library's own Viterbi
    other.write_bytes(raw[:at + 8] + b"\x01" + raw[at + 9:])
    sp = sentencepiece.SentencePieceProcessor(model_file=str(other))
    texts = [prose(200, 60), "Hello world", "x", "don't stop", "naïve café 你好", "a" * 400, WORDS[0]]
    odd = [None, "", " ", "  two  blanks ", "tab\tand\nline", "▁ own ▁▁ sign", "🙂 emoji \x00 nul", "x " * 20000, " é" * 30]
    docs = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, PIECE_MODEL).collect()}
    vocab = pieces.load(PIECE_MODEL)
    for i, t in enumerate(texts):
        assert got[i] == sp.encode(t), t
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, PIECE_MODEL), PIECE_MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts + odd)}
    rows = pieces.coded(docs, PIECE_MODEL).collect()
    assert all(r["same"] for r in rows) and {r["doc_id"]: r["n_pieces"] for r in rows} == {i: len(x) for i, x in got.items()}
    assert sum(vocab.values[np.array(got[len(texts) + 5])] >= 0) == 9  # three signs of three bytes
    assert pieces.encode(docs.limit(0), PIECE_MODEL).count() == 0


def test_repeated_rows_give_a_piece_once(spark):
    docs = suffixes.keyed(spark.createDataFrame([(1, "abcdefgh")] * 40 + [(2, "abcdefgh"), (1, "other")], "doc_id long, text string"))
    asked = docs.where("octet_length(data) = 8").groupBy("doc", "tie").agg(
        F.array(F.struct(F.lit(5).cast("long").alias("h"), F.lit(2).cast("long").alias("start"), F.lit(3).alias("span"))).alias("asked"))
    got = suffixes._pieces(docs, asked).collect()
    assert sorted((r["doc"], r["h"], r["start"], bytes(r["piece"])) for r in got) == [(1, 5, 2, b"cde"), (2, 5, 2, b"cde")]


def test_labels_of_absent_documents_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    more = labels.unionByName(spark.range(10**6, 10**6 + 3000).select(F.col("id").alias("doc_id"), F.lit(1).cast(labels.schema["toxic"].dataType).alias("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, more)


def test_toxicity_by_a_plain_version(spark):
    """Weights, extreme-value law and scores, written out for a small corpus."""
    import math
    import random
    import re

    rng = random.Random(11)
    common, bad = [f"w{chr(97 + i)}" for i in range(20)], ["vile", "foul", "nasty"]
    texts = {i: " ".join(rng.choice(common) for _ in range(rng.randrange(5, 60))) for i in range(240)}
    marks = {i: int(i % 6 == 0) for i in range(200)}
    for i in range(1, 200, 36):  # a single bad word does not make these toxic
        texts[i] += " " + bad[i % 3]
    for i in range(0, 240, 6):
        words = texts[i].split()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(bad, 2)
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([*texts.items(), (500, None), (501, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"))
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    t, c, n = {}, {}, [0, 0]
    for i, y in marks.items():
        n[y] += 1
        for w in set(split(texts[i])):
            (t if y else c)[w] = (t if y else c).get(w, 0) + 1
    total, weights = sum(t.values()) + sum(c.values()), {}
    for w in {*t, *c}:
        a, b = t.get(w, 0), c.get(w, 0)
        prior = 0.5 + 100 * (a + b) / total
        odds = math.log((a + prior) / (n[1] + 1)) - math.log((b + prior) / (n[0] + 1))
        if abs(odds) >= 3 * math.sqrt(1 / (a + prior) + 1 / (b + prior)):
            weights[w] = odds - 0.05
    assert set(bad) <= set(model.weights) == set(weights) and all(abs(model.weights[w] - x) < 1e-9 for w, x in weights.items())
    shares = {w: c.get(w, 0) for w in weights}
    rest = max(sum(c.values()) - sum(shares.values()), 1)
    every = sum(shares.values()) + rest
    assert abs(sum(shares[w] / every * math.exp(model.rate * x) for w, x in weights.items()) + rest / every * math.exp(-0.05 * model.rate) - 1) < 1e-6

    def plain(text):  # all maximal segments by their definition: no proper part or extension does better
        x = [weights.get(w, -0.05) for w in split(text)]
        left, out = [(0, len(x))], []
        while left:
            s, e = left.pop()
            best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(s, e) for j in range(i + 1, e + 1)), default=(0,))
            if best[0] > 1e-12:
                out.append(best[0])
                left += [(s, best[2]), (best[3], e)]
        return out, len(x)

    got = {r["doc_id"]: r for r in toxicity.best_segments(docs, model).collect()}
    for i in [*range(0, 240, 7), 500, 501]:
        found, size = plain(texts.get(i, ""))
        norm = sorted((model.rate * x - math.log(model.k * max(size, 1)) for x in found), reverse=True) or [-math.log(model.k * max(size, 1))]
        stat = norm[0]
        for r in range(2, len(norm) + 1):
            x = sum(norm[:r])
            if norm[r - 1] > 0 and x > r:
                stat = max(stat, -math.log(math.exp(-x) * x ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) * 2 ** (r - 1)))
        assert abs(got[i]["statistic"] - stat) < 1e-6
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-(model.slope * stat + model.shift)))) < 1e-6
    assert all((got[i]["score"] >= 0.7) == (i % 6 == 0) for i in range(200, 240))


def test_several_passages_count_together():
    model = toxicity.Model({}, 0.0, 1.0, 1.0, 1.0, 0.0)
    one, two = toxicity._combined([9.0], 100, model), toxicity._combined([9.0, 8.9], 100, model)
    assert one == 9 - np.log(100) and two > one
    assert toxicity._combined([9.0, 4.0], 100, model) == one and toxicity._combined([], 100, model) == -np.log(100)


def test_tiny_and_huge_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(4, 8))
    sizes = [1.0, 1e-200, 1e200, 1e-305, 1e300]
    rows = [(10 * k + s, (base[k] * size).tolist(), 1) for k in range(4) for s, size in enumerate(sizes)] + [(90, [5e-324, 0.0], 1), (91, [1e300, 1.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in vectors.near_duplicates(docs, tile=4).collect()}
    assert got == {**{v: (4, v - v % 10) for v, *_ in rows[:20]}, 90: (1, 90), 91: (1, 90)}


def test_long_words_are_segmented_by_windows():
    import tracemalloc

    vocab = pieces.load(PIECE_MODEL)
    r = np.random.default_rng(5)
    pool = np.frombuffer("".join(WORDS).encode("utf-32-le"), dtype=np.uint32)
    for n, size in ((3, 700), (1, 2000), (40, 90)):
        points = r.choice(pool, (n, size))
        points[:, 100:160] = ord("a")
        whole = pieces.viterbi(points, vocab, 10**6)
        for cells in (1, 50 * n, 64 * n + 1):
            assert all((x == y).all() for x, y in zip(pieces.viterbi(points, vocab, cells), whole))
    peaks = []
    for size in (20_000, 60_000):  # both longer than a window
        points = r.choice(pool, (1, size))
        tracemalloc.start()
        pieces.viterbi(points, vocab, 5000)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 40_000 * 30
