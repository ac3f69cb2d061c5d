"""Sinks: grids, splits, statistics, models, forecasts and history exports."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.frames import as_scalar, bind, one_of, one_row, spread, time_number
from gridspark.functions.quantiles import percentiles

STATS_SCHEMA = "feature string, mean double, std double, min double, max double, median double"


BOX_BITS = 10   # per dimension


def _apart(x: Column) -> Column:
    """The bits of a number of ``BOX_BITS`` bits, two zero bits between each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def box_code(df: DataFrame, time: str = "time", lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, Column]:
    """``df`` with the extents it needs as column ``_row``, and the Morton code of a cell.

    Each dimension is cut into 2^BOX_BITS parts between its extremes and their bits alternate, so rows that are near in code
    are near in time, latitude and longitude.  Missing coordinates count as the lowest.
    """
    spots = {"t": time_number(df, time), "y": F.col(lat).cast("double"), "x": F.col(lon).cast("double")}
    ends = {f"{end}_{k}": fn(v) for k, v in spots.items() for end, fn in (("lo", F.min), ("hi", F.max))}
    held, row = bind(df, one_row(df, **ends))

    def part(k: str) -> Column:
        width = row[f"hi_{k}"] - row[f"lo_{k}"]
        share = F.coalesce(F.try_divide(spots[k] - row[f"lo_{k}"], width), F.lit(0.0))
        return _apart(F.least(F.floor(share * (1 << BOX_BITS)), F.lit((1 << BOX_BITS) - 1)).cast("int"))

    return held, F.shiftleft(part("t"), 2).bitwiseOR(F.shiftleft(part("y"), 1)).bitwiseOR(part("x"))


def write_grid(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", order: str = "boxes") -> None:
    """Write a grid partitioned by year, so that time ranges prune whole folders.

    With ``boxes``, files are ranges of a Morton code and rows follow it, so the extremes that files, row groups and pages keep
    are narrow in every dimension, and the range filters of ``read_grid`` skip what lies outside a box.  Ranges are cut by sampled size, so a
    year with a large part of all rows has as many files as it needs.  With ``time``, rows of a file stand by time and position.
    """
    if fmt not in ("parquet", "orc"):
        raise ValueError(f"unsupported grid format '{fmt}'")
    one_of(order, ("boxes", "time"), "order")
    out = df.withColumn("year", F.year("time"))
    if order == "boxes":
        held, code = box_code(out)
        out = held.withColumn("_code", code).repartitionByRange("year", "_code").sortWithinPartitions("year", "_code").drop("_row", "_code")
    else:
        out = out.hint("rebalance", "year").sortWithinPartitions("year", "time", "lat", "lon")
    out.write.mode(mode).partitionBy("year").format(fmt).save(path)


def write_splits(df: DataFrame, path: str, features: Sequence[str], target: str, mode: str = "overwrite") -> None:
    """Rows by split under ``data`` and the feature names under ``meta``."""
    df.write.mode(mode).partitionBy("split").parquet(f"{path}/data")
    meta = df.sparkSession.createDataFrame([(list(features), target)], "features array<string>, target string")
    meta.coalesce(1).write.mode(mode).json(f"{path}/meta")


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], str]:
    meta = spark.read.schema("features array<string>, target string").json(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/data"), list(meta["features"]), meta["target"]


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, population deviation, min, max and median per feature, one row each."""
    cols = list(cols)
    med = as_scalar(percentiles(df, cols, [0.5]))
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                             F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
                    for c in cols])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), *[F.col(f"{c}.{k}").alias(k) for k in ("mean", "std", "min", "max")],
        med[c][0].alias("median")) for c in cols])))


def write_stats(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Statistics have one row per feature; they go to a single JSON file."""
    df.coalesce(1).write.mode(mode).json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path)


def stats_medians(stats: DataFrame) -> dict[str, float]:
    """Medians by feature name, as the scoring operators take them (one entry per feature)."""
    return {r["feature"]: r["median"] for r in stats.select("feature", "median").collect()}


def save_model(model: PipelineModel, path: str, features: Sequence[str], classes: Sequence[str],
               spark: SparkSession, **metadata) -> None:
    """Fitted stages under ``model``; feature list, classes and metadata under ``meta``."""
    model.write().overwrite().save(f"{path}/model")
    info = {"training_date": datetime.now(timezone.utc).isoformat(), **metadata}
    row = [(list(features), list(classes), json.dumps(info, sort_keys=True))]
    (spark.createDataFrame(row, "features array<string>, classes array<string>, info string")
     .coalesce(1).write.mode("overwrite").json(f"{path}/meta"))


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = spark.read.schema("features array<string>, classes array<string>, info string").json(
        f"{path}/meta").first()
    info = {"features": list(meta["features"]), "classes": list(meta["classes"]), **json.loads(meta["info"])}
    return PipelineModel.load(f"{path}/model"), info


def write_forecast(df: DataFrame, folder: str, stamp: str | None = None) -> str:
    """Forecast as CSV under a time-stamped name; nested features become JSON text."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/pollution_forecast_{stamp}"
    flat = df.withColumn("features", F.to_json("features")) if "features" in df.columns else df
    flat.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def export_history(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Chosen columns of the records as CSV."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


FOLDER_FILES = 1000   # of a folder of ``write_line_files``


def _line_files(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's rows as files under a hidden folder of this attempt; gives the name the folder is to get."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, folder, n = uuid.uuid4().hex, "", 0
        for batch in batches:
            for line in batch["line"]:
                if n % FOLDER_FILES == 0:
                    os.makedirs(folder := f"{path}/_{name}/{n // FOLDER_FILES}")
                with open(f"{folder}/{n}.txt", "wb") as file:
                    file.write((b"" if line is None else bytes(line)) + b"\n")
                n += 1
        if n:
            yield pd.DataFrame({"name": [name]})

    return write


def write_line_files(df: DataFrame, path: str) -> None:
    """Each row of a one-column text table as a line in a text file of its own.

    Files cost more than rows, so all tasks share them.  In a folder that every task mounts (``file:``) tasks write by themselves, as
    Spark's writer takes milliseconds per file there; each attempt has a hidden folder, and those of the attempts that count get
    their names in the end, so a repeated task leaves no second copy.  Other stores go through Spark's writer.
    """
    spark, (text,) = df.sparkSession, df.columns
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        spread(df).write.option("maxRecordsPerFile", 1).text(path)
        return
    if store.exists(place):
        raise FileExistsError(path)
    store.mkdirs(place)
    lines = spread(df.select(F.col(text).cast("binary").alias("line")))
    for row in lines.mapInPandas(_line_files(place.toUri().getPath()), "name string").collect():  # one per task
        hidden, shown = (spark._jvm.org.apache.hadoop.fs.Path(place, f"{x}{row['name']}") for x in ("_", ""))
        if not store.rename(hidden, shown):
            raise OSError(f"not renamed: {hidden}")
