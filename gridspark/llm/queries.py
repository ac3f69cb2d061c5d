"""The registered queries: each applies an operator to its whole table and derives its digest columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.frames import shared_folder
from gridspark.llm import (chat, licenses, mixing, negatives, pieces, quality, runs, sharding, simhash, suffixes, tokens, toxicity,
                           vectors)

PIECE_MODEL = os.environ.get("GRIDSPARK_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
WORD_MODEL = os.environ.get("GRIDSPARK_WORD_MODEL", "/opt/tokenizers/word_bpe_49k.json")
SHARDS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The old layout has the documents of a source in one shard, given by the source's name; the new one is even by bytes.

    The affected shards are written, and sizes, checksums and shards are those of the written files.
    """
    docs = table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(SHARDS))
    placed = sharding.move(docs, old, SHARDS, SHARDS, shared_folder(spark, "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "quality")


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], rows.schema)
    made = chat.format_chats(rows.unionByName(more))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"]))
    made = made.select("conv_id", "formatted", "state", "valid", turns.alias("turns"), F.array_join(learnt, "").alias("learnt"))
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    found = toxicity.best_segments(docs, toxicity.train(docs, labels))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of every document that is like a licence template."""
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


def op7_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded and decoded again: numbers of pieces, a checksum of the ids, and whether the text came back."""
    return pieces.coded(table(spark, folder, "documents").select("doc_id", "text"), PIECE_MODEL)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op10_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.removal_report(table(spark, folder, "documents").select("doc_id", "text"))


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", shifted))


def op12_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), WORD_MODEL)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = runs.with_loops(table(spark, folder, "documents").select("doc_id", "text"))
    found = runs.collapse_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    found = found.select("doc_id", "n_words", "collapsed", F.size("runs").cast("long").alias("n_runs"), lines.alias("lines"), longest.alias("top"))
    length, period = F.col("top")["length"], -F.col("top")["col3"]
    return found.select(
        "doc_id", "n_runs", (-F.col("top")["col2"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_quality, op4_chat, op5_toxicity, op6_licenses, op7_vectors,
                                   op8_pieces, op9_simhash, op10_suffixes, op11_negatives, op12_tokens, op13_runs)}
