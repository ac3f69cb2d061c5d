"""Mixing, quality, chat and sharding against plain Python, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridspark.llm.common import components
from gridspark.llm import chat, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
REPEATED = " ".join(f"w{i % 11}" for i in range(60))
ROWS = [(1, "one two three four", "en", "a", 1), (2, None, "en", "b", None), (3, "", None, None, 0), (None, "x y z", "en", "b", 2),
        (5, "same text here", "de", "a", 3), (5, "same text here", "de", "a", 3), (6, "word " * 3000, "en", "a", 4),
        (7, "dup\ndup\n \ndup x\n#$ a*b", "en", "c", 5), (8, REPEATED, "en", "Ä", 6), (9, "ONE TWO!! " * 20, "en", "é", 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def water(sizes, weights, total):
    caps, level = {s: 2.0 * n for s, n in sizes.items()}, dict.fromkeys(sizes, 0.0)
    free, rest = set(sizes), float(total)
    while free:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= caps[s]}
        if not over:
            return level | share
        for s in over:
            level[s] = caps[s]
            rest -= caps[s]
        free -= over
    return level


def test_mixing(docs):
    rows = mixing.with_copies(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        if r["source_size"]:
            rate = r["target"] / r["source_size"]
            assert int(rate) <= r["copies"] <= int(rate) + 1
    again = mixing.mix(docs.withColumn("size", F.lit("own")).withColumn("copy", F.lit(9)))
    assert again.columns == [*docs.columns, "size", "copy"]
    assert again.count() == sum(r["copies"] for r in rows) and {r["size"] for r in again.collect()} == {"own"}


def test_mixing_comes_near_its_targets(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), (F.col("id") % 7 + 1).cast("int"))).alias("text"),
                                     F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.with_copies(rows).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) < 0.05 * r["g"] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.with_copies(none).count() == mixing.mix(none).count() == quality.judge(none).count() == 0
    assert sharding.reshard(none, F.lit(0), 2, 3)[0].count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(docs):
    rows = quality.judge(docs).collect()
    texts = Counter(plain_stats(r[1]) for r in ROWS)
    assert Counter(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows) == texts
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1


def test_quality_finds_the_odd_kind(spark):
    good = [(i, " ".join(f"plain{i}x{j}" for j in range(60))) for i in range(80)]
    bad = [(1000 + i, " ".join(f"odd{i}x{j}***" for j in range(60))) for i in range(10)]
    rows = quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows if r["kept"]} == {i for i, _ in good}


CHATS = [(1, 0, "user", "a [INST] \\o \\\\ </s>"), (1, 1, "assistant", "b]\n[/INST]\\"), (2, 1, "assistant", "x"), (2, 0, "user", None),
         (3, 0, "assistant", "first"), (3, 1, "user", ""), (4, 0, "tool[1]", "t"), (4, 0, None, "n"), (None, 0, "user", "u"), (None, 1, "assistant", "ü<s>"),
         (5, 0, "system", "s"), (5, 1, "user", "q"), (5, 2, "assistant", "é" * 50000), (6, None, "user", "q"), (6, None, "user", "q")]


def test_chat(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    made = chat.format_chats(rows)
    got = {r["conv_id"]: r for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    for conv in {c[0] for c in CHATS}:
        turns = sorted(((c[1], c[2] or "", c[3] or "") for c in CHATS if c[0] == conv), key=lambda t: (t[0] is not None, *t[1:]) if t[0] is None else (True, *t))
        r = got[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[1], t[2]) for t in turns]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(t[1] == "assistant" for t in turns)
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: True, 5: True, 6: False}
    assert hashlib.sha256("é".encode() * 50000).hexdigest() == made.where("conv_id = 5").select(F.sha2(chat.unescape(
        F.element_at(F.filter("segments", lambda s: s["loss"]), 1)["text"]), 256)).first()[0]


def test_flow_moves_the_least():
    have, room = [90, 0, 10, 20], [30, 30, 30, 30]
    flow = sharding.min_cost_flow(have, room)
    assert all(sum(f for (a, _), f in flow.items() if a == i) == h for i, h in enumerate(have))
    assert all(sum(f for (_, b), f in flow.items() if b == j) <= r for j, r in enumerate(room))
    assert sum(f for (i, j), f in flow.items() if i != j) == sum(max(0, h - r) for h, r in zip(have, room))
    dear = sharding.min_cost_flow([5, 5], [5, 5], cost=lambda i, j: [[9, 1], [1, 9]][i][j])
    assert dear == {(0, 1): 5, (1, 0): 5}


def test_reshard(spark, docs, tmp_path):
    placed, flow = sharding.reshard(docs, F.lit(0), 1, 3)
    rows = placed.collect()
    assert len(rows) == len(ROWS) and Counter(r["size"] for r in rows) == Counter(len((t or "").encode()) + 8 for _, t, *_ in ROWS)
    assert {r["text_crc32"] for r in rows} == {None if t is None else zlib.crc32(t.encode()) for _, t, *_ in ROWS}
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 40).cast("int")).alias("text"))
    old = F.when(F.col("doc_id") < 4000, 0).otherwise(2)
    placed, flow = sharding.reshard(many, old, 3, 6, block_rows=300)
    sizes = {r["shard"]: r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 88
    moved = placed.where("old_shard <> shard").agg(F.sum("size")).first()[0]
    assert abs(moved - sum(f for (i, j), f in flow.items() if i != j)) <= 6 * 88
    folder = str(tmp_path / "shards")
    both = many.join(placed.select("doc_id", F.col("shard").alias("s")), "doc_id")
    sharding.rewrite(both.drop("s"), F.col("doc_id") % 6, range(6), folder)
    sharding.rewrite(both.drop("s").where("doc_id < 600"), F.col("doc_id") % 6, [1], folder)
    left = {r["shard"]: r["count"] for r in spark.read.parquet(folder).groupBy("shard").count().collect()}
    assert left[1] == 100 and left[0] == 834


def test_rewrite_clears_emptied_shards(spark, tmp_path):
    docs, folder = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), str(tmp_path / "shards")
    sharding.rewrite(docs, F.col("doc_id") % 4, range(4), folder)
    sharding.rewrite(docs.where("doc_id % 4 <> 2"), F.col("doc_id") % 2, [0, 1, 3], folder)
    left = {r["shard"]: r["count"] for r in spark.read.parquet(folder).groupBy("shard").count().collect()}
    assert left == {0: 15, 1: 30, 2: 15} and not (tmp_path / "shards" / "shard=3").exists()


@pytest.mark.parametrize("capacities", [None, [10_000, 0]])
def test_move_shrinks(spark, tmp_path, capacities):
    rows = [(i % 90, f"text {i % 90} é" * (i % 7) if i % 9 else None, "en", "abcd"[i % 4], i) for i in range(200)] + [(5, "same", "en", "a", 0)] * 50
    path, folder = str(tmp_path / "documents"), str(tmp_path / "shards")
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    docs, old = spark.read.parquet(path), F.ascii("source") - 97
    sharding.rewrite(docs, old, range(4), folder)
    got = sharding.move(docs, old, 4, 2, folder, capacities).collect()
    files = spark.read.parquet(folder).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in files) == Counter(rows)
    assert {r["shard"] for r in files} == ({0} if capacities else {0, 1})
    plain = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, None if r["text"] is None else zlib.crc32(r["text"].encode()),
                     "abcd".index(r["source"]), r["shard"], r["slot"]) for r in files)
    assert plain == Counter(tuple(r[c] for c in ("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")) for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_move_leaves_what_fits(spark, tmp_path):
    path, folder = str(tmp_path / "documents"), str(tmp_path / "shards")
    spark.createDataFrame([(i, "abc", "en", "abc"[i % 3], 3) for i in range(30)], DOCS).write.parquet(path)
    docs, old = spark.read.parquet(path), F.ascii("source") - 97
    got = sharding.move(docs, old, 3, 3, folder, [55, 165, 110]).collect()
    assert Counter(r["shard"] for r in got) == {0: 5, 1: 15, 2: 10}
    assert {r["shard"] for r in spark.read.parquet(folder).collect()} == {0, 1}
    assert len(sharding.move(docs, old, 3, 3, str(tmp_path / "none"), [110] * 3).collect()) == 30 and not (tmp_path / "none").exists()


def test_op2_writes_the_shards(spark):
    from pathlib import Path

    from gridspark.llm.queries import QUERIES

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before, folder = set(shared.glob("shards-*")), "/root/testdata/sf0.001"
    rows = QUERIES["op2_sharding"](spark, folder).collect()
    new = set(shared.glob("shards-*")) - before
    assert len(new) == 1
    files = spark.read.parquet(str(new.pop())).collect()
    texts = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    assert texts(files) <= texts(spark.read.parquet(f"{folder}/documents.parquet").collect())
    moved = Counter((r["doc_id"], r["shard"], r["slot"]) for r in files)
    shards = {r["shard"] for r in files}
    assert moved == Counter((r["doc_id"], r["shard"], r["slot"]) for r in rows if r["shard"] in shards)
    assert all(r["shard"] in shards for r in rows if r["shard"] != r["old_shard"])


def test_reshard_cuts_blocks_of_repeated_rows(spark):
    rows = [(7, "same text")] * 300 + [(i, f"text {i}") for i in range(100)]
    placed, _ = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(0), 1, 3, block_rows=10)
    got = placed.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    total = sum(r["size"] for r in got)
    for s in range(3):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 3) <= 2 * max(r["size"] for r in got)


def test_move_takes_clashing_column_names(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 7), -i, "a", 1.5, "f", 3, "d") for i in range(90)]
    kind = "doc_id long, text string, shard int, Slot string, old_shard double, _file string, _at int, _doc string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = str(tmp_path / "shards")
    got = sharding.move(docs, F.pmod("doc_id", F.lit(3)), 3, 2, folder).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(90)) and {r["shard"] for r in got} == {0, 1}
    back = spark.read.parquet(folder)
    assert {"shard", "Slot", "old_shard", "_file", "_at", "_doc", "shard_", "slot_", "old_shard_"} == {*back.columns, "doc_id", "text"} - {"doc_id", "text"}
    assert {(r["doc_id"], r["shard"], r["Slot"], r["old_shard"]) for r in back.collect()} <= {(r[0], r[2], r[3], r[4]) for r in rows}
    to = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert all(to[r["doc_id"]] == (r["shard_"], r["slot_"]) for r in back.collect())
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, n) for s in (0, 1) for n in range(sum(r["shard"] == s for r in got)))


def _spread(spark, hot, rest):
    return [(0, i) for i in range(1, hot)] + [(hot + i, hot + i + 1) for i in range(rest) if i % 3]


def test_components_with_a_hot_node(spark):
    links = _spread(spark, 3000, 300)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), hot=50).collect()}
    want = {i: 0 for i in range(1, 3000)}
    for a, b in links:
        if a >= 3000:
            want[b] = want.get(a, a)
    assert got == want
