"""Whole preprocessing: fill, clip, scale, derive and smooth a grid, with reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import COORDS, numeric_columns, present, shared_folder
from gridspark.operators.align import densify
from gridspark.operators.derive import derive_features
from gridspark.operators.missing import fill_missing
from gridspark.operators.outliers import detect_outliers, handle_outliers
from gridspark.operators.scaling import scale
from gridspark.operators.stats import validate
from gridspark.operators.temporal import temporal_filter

Stage = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class CleaningPlan:
    """What each step does; ``None`` switches a step off."""

    fill: str | None = "interpolate"
    fill_limit: int = 3
    outlier_method: str = "iqr"
    outlier_threshold: float = 3.0
    outliers: str | None = "clip"
    scaling: str | None = "standard"
    derive: bool = True
    derive_first: bool = False
    smoothing: str | None = "savgol"
    window: int = 7


@dataclass(frozen=True)
class Cleaned:
    data: DataFrame
    before: DataFrame
    after: DataFrame
    outliers: DataFrame
    plan: CleaningPlan
    scaled: tuple[str, ...]
    created: tuple[str, ...] = field(default=())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and go on from the files.

    Later steps ask for statistics of a stage several times; from files each of them is a
    pruned scan, and a lost executor only repeats the step it was working on.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(df: DataFrame, target: str = "pp", plan: CleaningPlan | None = None, stage: Stage = written) -> Cleaned:
    """Validate, fill, clip, scale all but the target, derive, smooth, validate again.

    Features are derived from scaled inputs unless ``plan.derive_first`` is set.
    """
    plan = plan or CleaningPlan()
    before = validate(df)
    cols = numeric_columns(df)
    data = densify(df).select(*present(df, COORDS), *cols)
    if plan.fill:
        data = fill_missing(data, cols, plan.fill, plan.fill_limit)
    data = stage(data, "filled")
    found = detect_outliers(data, cols, plan.outlier_method, plan.outlier_threshold)
    if plan.outliers:
        data = handle_outliers(data, cols, plan.outliers)
    if plan.derive and plan.derive_first:
        data = derive_features(data)
    data = stage(data, "clipped")
    features = [c for c in numeric_columns(data) if c.lower() != target.lower()]
    if plan.scaling:
        data = scale(data, features, plan.scaling)
    if plan.derive and not plan.derive_first:
        data = derive_features(data)
    created = tuple(c for c in data.columns if c not in df.columns)
    if plan.smoothing:
        data = stage(data, "derived")
        calendar = {"day_of_year", "month", "season_sin", "season_cos"}
        data = temporal_filter(data, [c for c in numeric_columns(data) if c not in calendar],
                               plan.smoothing, plan.window)
    return Cleaned(data, before, validate(data), found, plan, tuple(features) if plan.scaling else (), created)


def summary_info(result: Cleaned) -> DataFrame:
    """One row: configuration, number and method of scaled variables, features created."""
    names = list(result.scaled)
    method = result.plan.scaling or "none"
    row = [(json.dumps(asdict(result.plan), sort_keys=True), len(names), {n: method for n in names},
            len(result.created), list(result.created))]
    return result.data.sparkSession.createDataFrame(
        row, "config string, scalers_applied int, scaler_methods map<string,string>, "
             "feature_count int, features_created array<string>")


def with_report(name: str, df: DataFrame) -> DataFrame:
    """Row count of a stage under its name."""
    return df.agg(F.lit(name).alias("step"), F.count("*").alias("rows"))


def step_names(steps: Sequence[str]) -> list[str]:
    known = ("process", "train", "evaluate")
    bad = [s for s in steps if s not in known]
    if bad:
        raise ValueError(f"unknown steps: {', '.join(bad)}")
    return [s for s in known if s in steps]
