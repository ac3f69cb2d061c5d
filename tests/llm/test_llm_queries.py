"""Registered queries against SQL, and the pipeline against its stages by brute force."""

import re
from collections import Counter

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import mixing
from gridspark.llm.oracles import ORACLES
from gridspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_held_out_toxicity(spark):
    rows = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    both = Counter((r["toxic"], r["predicted"]) for r in rows.join(labels, "doc_id").collect())
    assert both[0, 1] == 0 and both[1, 1] >= 0.6 * (both[1, 0] + both[1, 1])


def test_quality_follows_labels(spark):
    rows = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Counter((r["quality"], r["kept"]) for r in rows.drop("quality").join(labels, "doc_id").collect())
    assert got[1, False] <= 0.05 * got[1, True] and got[0, True] <= 0.1 * got[0, False]


def test_pieces_come_back(spark):
    rows = QUERIES["op8_pieces"](spark, FOLDER)
    assert rows.where("same").count() == rows.count() == 200


def test_pipeline(spark, tmp_path):
    from test_llm_texts import brute_components, brute_removed, plain_print

    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == spark.read.parquet(f"{FOLDER}/documents.parquet").dtypes
    clean = sorted(r["doc_id"] for r in left["toxicity"])
    assert set(clean) <= set(rows) and all(rows[r["doc_id"]]["text"] == r["text"] for r in left["toxicity"])
    prints = [plain_print(rows[d]["text"]) for d in clean]
    low = brute_components(len(clean), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 2)
    one = sorted({clean[i] for i in low})
    assert sorted(r["doc_id"] for r in left["simhash"]) == one
    gone = brute_removed([(d, (rows[d]["text"] or "").encode()) for d in one])
    for r in left["suffixes"]:
        data = (rows[r["doc_id"]]["text"] or "").encode()
        want = bytes(b for b, g in zip(data, gone[r["doc_id"]]) if not g).decode("utf-8", "ignore")
        assert r["text"] == want and r["n_chars"] == len(want)
    assert sorted(r["doc_id"] for r in left["suffixes"]) == one
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(spark.read.parquet(str(tmp_path / "suffixes"))).collect()}
    assert Counter(r["doc_id"] for r in left["mixing"]) == Counter({d: n for d, n in copies.items() if n})
    assert Counter(r["doc_id"] for r in left["pieces"]) == Counter(r["doc_id"] for r in left["mixing"])
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == Counter(r["doc_id"] for r in left["mixing"])
    assert re.match(r"[a-z]", corpus_pipeline.STAGES[0][0])
