"""A kernel machine by random Fourier features: columns the JVM computes, a linear machine behind them, calibrated probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import shared_folder


def fourier_weights(inputs: int, count: int, gamma: float, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Directions (``count`` x ``inputs``) and phases; each depends on the seed and its own number, so more features extend fewer."""
    w, b = np.zeros((count, inputs)), np.zeros(count)
    for j in range(count):
        rng = np.random.default_rng((seed, j))
        w[j], b[j] = rng.normal(0.0, np.sqrt(2 * gamma), inputs), rng.uniform(0, 2 * np.pi)
    return w, b


def fourier_features(features: Sequence[str], means: Sequence[float], scales: Sequence[float], gamma: float, count: int = 256, seed: int = 42) -> Column:
    """An array of ``count`` features whose inner product of two rows is close to exp(-gamma |x - y|^2) of the scaled rows.

    The error of a pair falls as 1 / sqrt(count): it exceeds e with probability below 2 exp(-count e^2 / 8) (Hoeffding).
    """
    w, b = fourier_weights(len(features), count, gamma, seed)
    slopes = w / np.asarray(scales)     # the scaling goes into weights and phases
    phases = b - slopes @ np.asarray(means)
    rows = F.array(*[F.struct(F.array(*[F.lit(float(s)) for s in r]).alias("w"), F.lit(float(p)).alias("b")) for r, p in zip(slopes, phases)])
    x = F.array(*[F.col(f).cast("double") for f in features])
    inner = lambda r: F.aggregate(F.zip_with(r["w"], x, lambda u, v: u * v), r["b"], lambda s, v: s + v)
    return F.transform(rows, lambda r: F.cos(inner(r)) * float(np.sqrt(2 / count)))


@dataclass
class KernelMachine:
    features: list[str]
    mapped: Column
    machine: OneVsRestModel
    calibrated: LogisticRegressionModel

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` and ``prediction``."""
        scored = self.calibrated.transform(self.machine.transform(df.withColumn("_rff", array_to_vector(self.mapped))))
        return scored.drop("_rff", "_nearest", "rawPrediction", "_odds")


def fit_kernel_svm(df: DataFrame, features: Sequence[str], label: str = "label", count: int = 256, gamma: float | None = None, rounds: int = 50,
                   seed: int = 42) -> KernelMachine:
    """A machine with Gaussian kernel of width ``gamma``, by default one over the number of scaled features.

    One linear machine per class, against the rest; a logistic regression on their margins gives probabilities.
    """
    row = df.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    n = len(features)
    means, scales = [float(v or 0) for v in row[:n]], [float(v or 0) or 1.0 for v in row[n:]]
    mapped = fourier_features(features, means, scales, gamma or 1.0 / n, count, seed)
    rows = df.select(F.col(label).cast("double").alias("label"), mapped.alias("_rff"))
    path = shared_folder(df.sparkSession, "kernel-rows")
    rows.write.parquet(path)   # every pass of the fit reads them
    rows = df.sparkSession.read.schema(rows.schema).parquet(path).withColumn("_rff", array_to_vector("_rff"))
    machine = OneVsRest(classifier=LinearSVC(labelCol="label", featuresCol="_rff", maxIter=rounds), labelCol="label", featuresCol="_rff",
                        predictionCol="_nearest", parallelism=3).fit(rows)
    calibrated = LogisticRegression(labelCol="label", featuresCol="rawPrediction", rawPredictionCol="_odds", maxIter=rounds).fit(machine.transform(rows))
    return KernelMachine(list(features), mapped, machine, calibrated)
