"""Small helpers on schemas, sizes and shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

COORDS = ("time", "lat", "lon")
CELL = ("lat", "lon")


def numeric_columns(df: DataFrame, skip: Iterable[str] = COORDS) -> list[str]:
    """Numeric columns of ``df`` in order, without ``skip``."""
    skip = {s.lower() for s in skip}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name.lower() not in skip]


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The requested names that exist, spelled as in ``df`` (case-insensitive)."""
    have = {c.lower(): c for c in df.columns}
    return [have[n.lower()] for n in names if n.lower() in have]


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if not present(df, [n])]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def one_of(value: str, allowed: Iterable[str], what: str) -> str:
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"unknown {what} '{value}', expected one of {allowed}")
    return value


def one_row(df: DataFrame, **exprs: Column) -> Column:
    """Aggregate ``df`` to one struct and hand it out as a scalar subquery.

    Spark runs the subquery once and inlines the struct as a constant, so whole
    columns can use it without a join.
    """
    return df.agg(F.struct(*[e.alias(k) for k, e in exprs.items()]).alias("s")).scalar()


def as_scalar(df: DataFrame) -> Column:
    """A DataFrame known to hold one row as a struct-typed scalar subquery."""
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).scalar()


def bind(df: DataFrame, row: Column, name: str = "_row") -> tuple[DataFrame, Column]:
    """``df`` with a scalar struct as column ``name``, and that column.

    Expressions that use several fields then share one subquery; drop the column afterwards.
    """
    return df.withColumn(name, row), F.col(name)


#: Most groups that ``lookup`` sends to every task: labels and levels, never keys of the data.
MAX_GROUPS = 1000


def _group_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys])


def lookup(small: DataFrame, keys: Sequence[str], name: str) -> Column:
    """Column ``name`` of a table with one row per group, for rows that carry the group's ``keys``.

    The table becomes one scalar map, so the rows are neither shuffled nor joined, however
    unequal the groups are.  More than ``MAX_GROUPS`` groups are an error.
    """
    entry = F.struct(_group_key(keys).alias("k"), F.col(name).alias("v"))
    few = small.limit(MAX_GROUPS + 1).agg(
        F.when(F.count("*") <= MAX_GROUPS, F.map_from_entries(F.collect_list(entry)))
        .otherwise(F.raise_error(F.lit(f"more than {MAX_GROUPS} groups of {', '.join(keys)}"))).alias("m"))
    return F.try_element_at(few.scalar(), _group_key(keys))


def over_series(cell: Sequence[str] = CELL, time: str = "time") -> WindowSpec:
    """The window all time-wise operators share, so that one shuffle serves them all."""
    return Window.partitionBy(*cell).orderBy(time)


def time_number(df: DataFrame, time: str = "time") -> Column:
    """Time as a DOUBLE on a true time scale (days for DATE, microseconds otherwise)."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("double")
    return F.unix_micros(F.col(time).cast("timestamp")).cast("double")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for Python work per group.

    Few bytes can mean much Python time, so the configured number of partitions is kept
    instead of being merged by size; grouping by ``keys`` needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master, as in tests, may fall back to the machine's own folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="gridspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
