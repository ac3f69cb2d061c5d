"""Structured Streaming versions of the online scoring operations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.operators.filters import recent, split_valid
from gridspark.operators.labels import score_rules
from gridspark.operators.scoring import score_or_rules


def sample_stream(spark: SparkSession, folder: str, schema: str | T.StructType, glob: str = "*.parquet",
                  files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, model: PipelineModel | None = None, features: Sequence[str] = (),
                 medians=None) -> DataFrame:
    """Valid samples with their scores; stateless, so equal to the batch result."""
    good, _ = split_valid(stream)
    return score_or_rules(good, model, features, medians)


def rejected_stream(stream: DataFrame) -> DataFrame:
    return split_valid(stream)[1]


def write_scores(scored: DataFrame, folder: str, available_now: bool = True):
    """Append to Parquet with a checkpoint next to it."""
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def history_counters(stream: DataFrame, ts: str = "ts", window: str = "30 days",
                     lateness: str = "36500 days") -> DataFrame:
    """Running total, scored and HIGH records per time window.

    The state has one row per window, so it grows with the calendar and not with the records.  A record
    that comes later than ``lateness`` after the newest is not counted; the default of a century counts all.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    scored = score_rules(timed.withWatermark("_ts", lateness))
    return (scored.groupBy(F.window("_ts", window)).agg(
        F.count("*").alias("total"), F.count("level").alias("successful"),
        F.count_if(F.col("level") == "HIGH").alias("high_risk"))
        .select(F.col("window.start").alias("window_start"), "total", "successful", "high_risk"))


def _turn(batch: DataFrame, number: int, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Merge a batch with the state of the one before.

    Two states exist, for even and for odd batches: a batch reads the other one and overwrites
    its own, so a repeated batch gives the same state and old states do not pile up.
    """
    before = batch.sparkSession.createDataFrame([], batch.schema)
    if number > 0:
        before = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/state/turn={(number - 1) % 2}")
    kept = merge(before, batch).withColumn("_batch", F.lit(number).cast("long"))
    kept.write.mode("overwrite").parquet(f"{folder}/state/turn={number % 2}")


def _newest_turn(spark: SparkSession, folder: str) -> DataFrame:
    states = spark.read.parquet(f"{folder}/state").drop("turn")
    return states.where(F.col("_batch") == states.agg(F.max("_batch")).scalar()).drop("_batch")


def write_counters(counters: DataFrame, folder: str, available_now: bool = True):
    """Windows that a batch changed replace their older rows; the files hold two states, however many batches ran."""
    def save(batch: DataFrame, number: int) -> None:
        _turn(batch, number, folder, lambda before, new: before.join(new, "window_start", "left_anti").unionByName(new))

    writer = (counters.writeStream.outputMode("update").foreachBatch(save)
              .option("checkpointLocation", f"{folder}/checkpoint"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every window."""
    return _newest_turn(spark, folder)


def keep_recent(stream: DataFrame, folder: str, n: int = 100, ts: str = "ts", tie: str = "id",
                available_now: bool = True):
    """Keep the newest ``n`` records: each batch is merged with the state of the one before."""
    def merge(batch: DataFrame, number: int) -> None:
        _turn(recent(batch, n, ts, tie), number, folder, lambda before, new: recent(before.unionByName(new), n, ts, tie))

    writer = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state."""
    return _newest_turn(spark, folder)
