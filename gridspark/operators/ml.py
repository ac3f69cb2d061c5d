"""Training, evaluation and uncertainty on MLlib."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS, bind, one_of, one_row
from gridspark.operators.boosting import fit_boosted
from gridspark.operators.kernels import fit_kernel_svm
from gridspark.operators.sampling import class_weights, folds

log = logging.getLogger(__name__)


def tree_count(n_train: int) -> int:
    """Number of trees for a training size: one per 100 rows within 50..200."""
    return max(50, min(200, n_train // 100))


def assemble(features: Sequence[str]) -> list:
    """Stages that turn columns into a centred, scaled vector."""
    return [VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]


def train_classifier(df: DataFrame, features: Sequence[str], label: str = "label", trees: int | None = None,
                     max_depth: int = 15, seed: int = 42) -> PipelineModel:
    """Random forest on scaled features with balanced class weights."""
    if trees is None:
        trees = tree_count(df.count())
    weighted = class_weights(df, label)
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=max_depth,
        minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[*assemble(features), forest]).fit(weighted)


def train_regressor(df: DataFrame, features: Sequence[str], target: str, trees: int = 100,
                    max_depth: int = 30, seed: int = 42) -> PipelineModel:
    """Random forest of MLlib for a numeric target, at most 30 levels deep; ``forests.fit_forest`` has no limit and its model grows as a table."""
    forest = RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees,
                                   maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[*assemble(features), forest]).fit(df)


def candidates(label: str = "label", trees: int = 100, rounds: int = 100, seed: int = 42) -> dict:
    """The models of a bake-off: estimators, or functions of training rows and features that give a fitted model."""
    return {
        "random_forest": RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=10, seed=seed),
        "gradient_boosting": lambda train, features: fit_boosted(train, features, label, rounds=rounds, depth=5, rate=0.1, seed=seed),
        "svm": lambda train, features: fit_kernel_svm(train, features, label, seed=seed),
        "logistic_regression": LogisticRegression(labelCol=label, maxIter=50),
    }


def train_all(train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "label",
              models: dict | None = None) -> tuple[dict, DataFrame]:
    """Fit all candidates and rank them by weighted F1 on the validation rows.

    The first row of the report is the best model; a candidate that fails stays in the report with its error.
    """
    fitted = {}
    reports, failed = [], []
    for name, model in (models or candidates(label)).items():
        try:
            fitted[name] = model(train, features) if callable(model) else Pipeline(stages=[*assemble(features), model]).fit(train)
        except Exception as e:  # noqa: BLE001 - the report names the failure
            log.warning("candidate %s failed: %s", name, e)
            failed.append((name, str(e)))
            continue
        scored = fitted[name].transform(val)
        reports.append(classification_metrics(scored, label, "prediction").select("*", F.lit(name).alias("model"), F.lit(None).cast("string").alias("error")))
    if not reports:
        raise ValueError("no candidate could be trained")
    report = reduce(DataFrame.unionByName, reports)
    if failed:
        lost = val.sparkSession.createDataFrame(failed, "model string, error string")
        report = report.unionByName(lost, allowMissingColumns=True)
    return fitted, report.orderBy(F.col("f1").desc_nulls_last(), "model")


def cross_validate(df: DataFrame, features: Sequence[str], keys: Sequence[str] = COORDS,
                   label: str = "label", estimator=None, k: int = 5, metric: str = "f1",
                   parallelism: int = 4) -> DataFrame:
    """Mean and deviation of a metric (``f1`` = weighted, or ``accuracy``) over k stratified folds."""
    estimator = estimator or candidates(label)["random_forest"]
    folded = folds(df, keys, k, label)
    cv = CrossValidator(
        estimator=Pipeline(stages=[*assemble(features), estimator]),
        estimatorParamMaps=ParamGridBuilder().build(), numFolds=k, foldCol="fold", parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName=metric))
    model = cv.fit(folded)
    row = [(metric, k, float(model.avgMetrics[0]), float(model.stdMetrics[0]))]
    return df.sparkSession.createDataFrame(row, "metric string, folds int, mean double, std double")


def tune(df: DataFrame, features: Sequence[str], grid: dict[str, Sequence], keys: Sequence[str] = COORDS,
         label: str = "label", estimator=None, k: int = 3, parallelism: int = 4) -> tuple[DataFrame, object]:
    """Grid search by weighted F1; returns all combinations, best first, and the best model."""
    estimator = estimator or RandomForestClassifier(labelCol=label, seed=42)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    cv = CrossValidator(
        estimator=Pipeline(stages=[*assemble(features), estimator]), estimatorParamMaps=maps,
        numFolds=k, foldCol="fold", parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"))
    model = cv.fit(folds(df, keys, k, label))
    rows = [(*[float(m[estimator.getParam(n)]) for n in grid], float(s))
            for m, s in zip(maps, model.avgMetrics)]
    schema = ", ".join(f"{n} double" for n in grid) + ", f1 double"
    report = df.sparkSession.createDataFrame(rows, schema).orderBy(F.col("f1").desc(), *grid)
    return report, model.bestModel


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (true class, predicted class)."""
    return df.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")
                      ).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; an undefined ratio is 0."""
    m = confusion(df, label, prediction)
    # both sides of the confusion matrix in one small table
    none = F.lit(0).cast("long")
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(none)

    def side(who: str, support: Column, said: Column, hit: Column) -> Column:
        return F.struct(F.col(who).alias("class"), support.alias("support"), said.alias("said"), hit.alias("hit"))

    sides = m.select(F.explode(F.array(side("actual", F.col("n"), none, right),
                                       side("predicted", none, F.col("n"), none))).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"),
                                     F.sum("hit").alias("hit"))
    p = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return per.select("class", p.alias("precision"), r.alias("recall"),
                      F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "hit")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row."""
    per = classification_report(df, label, prediction)
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), w("precision"), w("recall"), w("f1"),
                   F.sum("support").alias("samples"))


def regression_report(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """mse, rmse, mae, r2, samples, and mean and deviation of both columns, in one aggregate."""
    y, p = F.col(target), F.col(prediction)
    row = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.count("*").alias("samples"),
        F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), F.avg(p).alias("pred_mean"),
        F.stddev_pop(p).alias("pred_std"))
    r2 = 1 - F.try_divide(F.col("mse"), F.col("y_std") * F.col("y_std"))
    return row.withColumns({"rmse": F.sqrt("mse"), "r2": r2})


def importance(model: PipelineModel, features: Sequence[str], k: int = 10) -> DataFrame:
    """The k most important features of a fitted forest."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def overfit_flag(train_scored: DataFrame, test_scored: DataFrame, label: str = "label",
                 gap: float = 0.05) -> DataFrame:
    """Train and test accuracy, their difference, and whether it exceeds ``gap``."""
    def accuracy(d: DataFrame) -> Column:
        return d.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).scalar()

    one = train_scored.sparkSession.range(1)
    row = one.select(accuracy(train_scored).alias("train_accuracy"), accuracy(test_scored).alias("test_accuracy"))
    diff = F.col("train_accuracy") - F.col("test_accuracy")
    return row.withColumns({"difference": diff, "overfit": diff > gap})


def predict_uncertainty(model: PipelineModel, df: DataFrame, out: str = "uncertainty") -> DataFrame:
    """Prediction of a forest and the population deviation of its trees.

    The trees share one assembled vector; each adds a column to the same row.
    """
    forest = model.stages[-1]
    scored = df
    for stage in model.stages[:-1]:
        scored = stage.transform(scored)
    names = []
    for i, tree in enumerate(forest.trees):
        names.append(f"_t{i}")
        tree = tree.copy({tree.predictionCol: names[-1]})
        scored = tree.transform(scored)
    votes = F.array(*names)
    n = float(len(names))
    mean = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / n
    scored = scored.withColumn("prediction", mean)
    var = F.aggregate(votes, F.lit(0.0), lambda a, x: a + (x - F.col("prediction")) * (x - F.col("prediction"))) / n
    return scored.withColumn(out, F.sqrt(var)).drop("raw", "features", *names)


def _replicates(rows: DataFrame, sums: dict[str, Column], keys: Sequence[str], replicates: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``rep``, ``by`` and the sums over rows, each row taken Poisson(1) times per replicate; ``_n`` is how often rows were taken.

    Each row draws its weights from the MD5 of seed, key and a number: eight hex digits per
    replicate, four replicates per digest, so a repeated task and another engine draw the same.
    Sums fold before the shuffle, which carries one row per digest number, group and task.
    """
    blocks = -(-replicates // 4)
    drawn = rows.select(*by, *[e.alias(f"_s_{k}") for k, e in sums.items()], *keys, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("block").cast("string")))
    drawn = drawn.withColumn("h", digest)
    # cut points of the Poisson(1) distribution function
    total, term, cuts = 0.0, 0.36787944117144233, []
    for i in range(12):
        total += term
        cuts.append(int(total * 2**32))
        term /= i + 1

    def weight(part: int) -> Column:
        u = F.conv(F.substring("h", 8 * part + 1, 8), 16, 10).cast("long")
        return reduce(Column.__add__, [(u >= c).cast("int") for c in cuts])

    drawn = drawn.select(*by, "block", *[f"_s_{k}" for k in sums], *[weight(p).alias(f"w{p}") for p in range(4)])
    out = drawn.groupBy(*by, "block").agg(*[F.sum(F.col(f"w{p}") * F.col(f"_s_{k}")).alias(f"{k}{p}") for p in range(4) for k in sums],
                                          *[F.sum(f"w{p}").alias(f"n{p}") for p in range(4)])
    four = [F.struct((F.col("block") * 4 + p).alias("rep"), *[F.col(f"{k}{p}").alias(k) for k in sums], F.col(f"n{p}").alias("_n")) for p in range(4)]
    return out.select(*by, F.inline(F.array(*four))).where(F.col("rep") < replicates)


def bootstrap(df: DataFrame, value: Column | str, keys: Sequence[str], replicates: int = 100, seed: int = 42,
              level: float = 0.95) -> DataFrame:
    """Bootstrap interval of a mean with Poisson(1) weights in one pass."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(v.alias("v"), *keys).where(F.col("v").isNotNull())
    means = _replicates(rows, {"s": F.col("v")}, keys, replicates, seed).select("rep", F.try_divide("s", "_n").alias("m"))
    tail = (1 - level) / 2
    q = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))
    point = one_row(rows, m=F.avg("v"), n=F.count("*"))
    out = means.agg(F.avg("m").alias("boot_mean"), F.stddev_samp("m").alias("std_error"), q.alias("q"))
    out, point = bind(out, point)
    return out.select(point["m"].alias("mean"), point["n"].alias("samples"), "boot_mean", "std_error",
                      F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_metric(df: DataFrame, metric: str, keys: Sequence[str], label: str = "label", prediction: str = "prediction", replicates: int = 100,
                     seed: int = 42, level: float = 0.95) -> DataFrame:
    """Bootstrap interval of ``accuracy``, weighted ``f1`` or ``r2`` of predictions: ``metric, point, samples, boot_mean, std_error, low, high``.

    A replicate is a handful of sums (a weighted confusion matrix, or moments), so no row is stored twice; replicate -1 takes every
    row once and gives the point.  Rows without label or prediction are left out.
    """
    one_of(metric, ("accuracy", "f1", "r2"), "metric")
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"), *keys).where("y IS NOT NULL AND p IS NOT NULL")
    y, p = F.col("y"), F.col("p")
    if metric == "r2":
        sums = {"e": (y - p) * (y - p), "a": y, "b": y * y}
        every = rows.agg(F.lit(-1).alias("rep"), *[F.sum(e).alias(k) for k, e in sums.items()], F.count("*").alias("_n"))
        taken = _replicates(rows, sums, keys, replicates, seed).unionByName(every)
        scored = taken.select("rep", "_n", (1 - F.try_divide(F.col("e"), F.col("b") - F.try_divide(F.col("a") * F.col("a"), F.col("_n")))).alias("m"))
    else:
        every = rows.groupBy("y", "p").agg(F.lit(-1).alias("rep"), F.count("*").alias("_n"))
        cells = _replicates(rows, {}, keys, replicates, seed, ["y", "p"]).unionByName(every)
        hit = F.when(y == p, F.col("_n")).otherwise(0)
        sides = cells.select("rep", F.inline(F.array(F.struct(y.alias("class"), F.col("_n").alias("support"), F.lit(0).alias("said"), hit.alias("hit")),
                                                     F.struct(p.alias("class"), F.lit(0).alias("support"), F.col("_n").alias("said"), F.lit(0).alias("hit")))))
        per = sides.groupBy("rep", "class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
        f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("said")), F.lit(0.0)) * F.col("support")
        scored = per.groupBy("rep").agg(F.sum("support").alias("_n"), F.try_divide(F.sum("hit") if metric == "accuracy" else F.sum(f1), F.sum("support")).alias("m"))
    drawn, tail = F.when(F.col("rep") >= 0, F.col("m")), (1 - level) / 2
    out = scored.agg(F.max(F.when(F.col("rep") < 0, F.col("m"))).alias("point"), F.max(F.when(F.col("rep") < 0, F.col("_n"))).alias("samples"),
                     F.avg(drawn).alias("boot_mean"), F.stddev_samp(drawn).alias("std_error"), F.percentile(drawn, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return out.select(F.lit(metric).alias("metric"), "point", "samples", "boot_mean", "std_error", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def uncertainty_map(df: DataFrame, var: str) -> DataFrame:
    """Mean and population deviation over time per position."""
    return df.groupBy("lat", "lon").agg(F.avg(var).alias("mean"), F.stddev_pop(var).alias("std"),
                                        F.count(var).alias("n"))


def confidence_of(probability: Column | str = "probability") -> Column:
    return F.array_max(vector_to_array(probability))
