"""Batch scoring with a model, rules, or both, and forecasts from the latest state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.frames import CELL, numeric_columns, present
from gridspark.operators.align import with_days
from gridspark.operators.labels import CLASSES, risk_level, score_rules
from gridspark.operators.missing import impute_features
from gridspark.operators.temporal import latest

# Example samples to try a model on.
SCENARIOS = (
    ("open_ocean", 0.11, 140.0, 0.03, 0.004, 0.002),
    ("shelf_winter", 0.65, 260.0, 0.07, 0.09, None),
    ("upwelling", 3.4, 1450.0, 0.24, 1.1, 0.4),
    ("river_plume", 4.2, None, 0.62, None, 0.9),
    ("estuary_summer", 11.7, 1980.0, 0.95, 2.6, 1.8),
)
SCENARIO_SCHEMA = "name string, chl double, pp double, kd490 double, diato double, green double"


def score(df: DataFrame, model: PipelineModel, features: Sequence[str], medians: Mapping[str, float] | None = None,
          classes: Sequence[str] = CLASSES, variant: str = "cli") -> DataFrame:
    """Add level, confidence (largest probability), probabilities and feature counts.

    Inputs stay as they are; imputed features only feed the model.
    """
    given = present(df, features)
    counted = F.lit(0)
    for c in given:
        counted = counted + F.col(c).isNotNull().cast("int")
    held = df.withColumn("_in", F.struct(*df.columns)).withColumn("features_provided", counted)
    ready = impute_features(held, features, medians, variant)
    scored = model.transform(ready)
    probs = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select(
        "_in.*", F.get(names, F.col("prediction").cast("int")).alias("level"), F.array_max(probs).alias("confidence"),
        F.map_from_arrays(names, probs).alias("probabilities"), "features_provided",
        F.lit(len(features)).alias("features_total"))


def score_or_rules(df: DataFrame, model: PipelineModel | None = None, features: Sequence[str] = (),
                   medians: Mapping[str, float] | None = None, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Model scores where there is a model and it gives a level, else rule scores."""
    if model is None:
        return score_rules(df).withColumns({"features_used": F.lit(1), "source": F.lit("rules")})
    by_model = score(df, model, features, medians, classes)
    by_rule = score_rules(by_model.withColumnsRenamed(
        {"level": "_level", "confidence": "_confidence", "probabilities": "_probabilities"}))
    ok = F.col("_level").isNotNull()
    return by_rule.withColumns({
        "level": F.coalesce("_level", "level"),
        "confidence": F.when(ok, F.col("_confidence")).otherwise(F.col("confidence")),
        "probabilities": F.when(ok, F.col("_probabilities")).otherwise(F.col("probabilities")),
        "features_used": F.when(ok, F.lit(len(features))).otherwise(F.lit(1)),
        "source": F.when(ok, "model").otherwise("rules"),
    }).drop("_level", "_confidence", "_probabilities", "features_provided", "features_total")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCENARIOS), SCENARIO_SCHEMA)


def score_scenarios(spark: SparkSession, model: PipelineModel | None = None, features: Sequence[str] = (),
                    medians: Mapping[str, float] | None = None) -> DataFrame:
    return score_or_rules(scenarios(spark), model, features, medians)


def seasonal_factor(date: Column) -> Column:
    return 1 + 0.1 * F.sin(2 * F.pi() * F.dayofyear(date) / 365.0)


def forecast(df: DataFrame, anchor, days: int = 7, cell: Sequence[str] = CELL, time: str = "time",
             model: PipelineModel | None = None, features: Sequence[str] = (),
             medians: Mapping[str, float] | None = None) -> DataFrame:
    """Scores of the latest row of each series under a seasonal factor, for ``days`` dates from ``anchor``.

    All numeric columns are scaled by the factor, coordinates included.
    """
    last = latest(df, cell, time)
    keys = [k for k in cell]
    ahead = with_days(last, days, anchor)
    numbers = numeric_columns(last, skip=[time])
    factor = seasonal_factor(F.col("date"))
    moved = ahead.select(*[F.col(k).alias(f"series_{k}") for k in keys], "date",
                         *[(F.col(c) * factor).alias(c) for c in numbers])
    scored = score_or_rules(moved, model, features, medians)
    pairs = [x for c in numbers for x in (F.lit(c), F.col(c).cast("double"))]
    return scored.select(*[f"series_{k}" for k in keys], "date", F.col("level").alias("predicted_level"),
                         "confidence", risk_level().alias("risk_level"), F.create_map(*pairs).alias("features"))
