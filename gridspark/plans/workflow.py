"""From several grids to a trained and evaluated model, step by step."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS
from gridspark.operators.align import merge_grids
from gridspark.operators.filters import choose_xy, drop_missing
from gridspark.operators.ml import regression_report, train_regressor
from gridspark.operators.sampling import split
from gridspark.plans.cleaning import step_names, with_report, written


def run(grids: Sequence[DataFrame], steps: Sequence[str] = ("process", "train", "evaluate"),
        target: str | None = None, features: Sequence[str] | None = None, trees: int = 100,
        max_depth: int = 10, seed: int = 42, stage=written) -> DataFrame:
    """Merge, keep complete rows, split, train and evaluate; one report row per step.

    A later step needs the earlier ones, as in ``process`` before ``train``.
    """
    todo = step_names(steps)
    reports = []
    if "process" not in todo:
        raise ValueError("the process step is needed first")
    table = drop_missing(merge_grids(grids))
    y, x = choose_xy(table, target, features)
    table = stage(split(table.select(*COORDS, *x, y), COORDS, seed=seed), "splits")
    reports.append(_report(with_report("process", table), None))
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    if "train" in todo:
        model = train_regressor(train, x, y, trees, max_depth, seed)
        reports.append(_report(with_report("train", train), None))
        if "evaluate" in todo:
            scored = regression_report(model.transform(test), y)
            reports.append(_report(scored.select(F.lit("evaluate").alias("step"),
                                                 F.col("samples").alias("rows"), "rmse", "r2"), "scored"))
    return reduce(DataFrame.unionByName, reports)


def _report(df: DataFrame, kind: str | None) -> DataFrame:
    if kind is None:
        df = df.withColumns({"rmse": F.lit(None).cast("double"), "r2": F.lit(None).cast("double")})
    return df.select("step", "rows", "rmse", "r2")
