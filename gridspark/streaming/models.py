"""Scoring by a model that is replaced while the stream runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.filters import split_valid
from gridspark.operators.labels import CLASSES
from gridspark.operators.scoring import score_or_rules
from gridspark.sources.sinks import load_model, save_model


def newest_version(spark: SparkSession, models: str) -> int | None:
    """Number of the newest published model; none while there is no model."""
    try:
        versions = spark.read.schema("version int").parquet(f"{models}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.agg(F.max("version")).first()[0]


def publish_model(spark: SparkSession, model: PipelineModel, models: str, features: Sequence[str],
                  medians: Mapping[str, float] | None = None, classes: Sequence[str] = CLASSES) -> int:
    """Save a model under the next number and list it, in this order, so that readers meet whole models only.

    One publisher at a time; a number is never written twice.
    """
    version = (newest_version(spark, models) or 0) + 1
    save_model(model, f"{models}/model={version}", features, classes, spark, medians=dict(medians or {}))
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{models}/versions")
    return version


def write_current_scores(stream: DataFrame, models: str, folder: str, available_now: bool = True):
    """Score each batch with the newest model of that moment, by rules while there is none; ``model_version`` tells which.

    The list of versions is read once a batch and a model is loaded once a version, so a new model counts from the next batch on
    without a restart.  A repeated batch overwrites its folder as a whole, maybe with a newer model.
    """
    held: dict[int, tuple[PipelineModel, dict]] = {}

    def save(batch: DataFrame, number: int) -> None:
        version = newest_version(batch.sparkSession, models)
        if version is not None and version not in held:
            held.clear()
            held[version] = load_model(batch.sparkSession, f"{models}/model={version}")
        model, info = held.get(version, (None, {}))
        good, _ = split_valid(batch)
        scored = score_or_rules(good, model, info.get("features", ()), info.get("medians"), info.get("classes", CLASSES))
        (scored.withColumn("model_version", F.lit(version).cast("int"))
         .write.mode("overwrite").parquet(f"{folder}/data/batch={number}"))

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data").drop("batch")
