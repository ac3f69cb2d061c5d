"""Projections, filters, validation and ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import CELL, COORDS, need, numeric_columns, present
from gridspark.functions.quantiles import percentile_row
from gridspark.operators.series import position

# Accepted ranges of scored samples (None = unbounded).
SAMPLE_RANGES = {
    "chl": (0.0, 50.0),
    "pp": (0.0, None),
    "kd490": (0.0, None),
    "diato": (0.0, None),
    "dino": (0.0, None),
    "cdm": (0.0, None),
    "bbp": (0.0, None),
}

# Coordinate names found in files.
COORD_NAMES = {"latitude": "lat", "longitude": "lon"}
COORD_ATTRS = {
    "lat": {"long_name": "latitude", "units": "degrees_north", "standard_name": "latitude"},
    "lon": {"long_name": "longitude", "units": "degrees_east", "standard_name": "longitude"},
}


def filter_time(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Rows with start <= time <= end."""
    return df.where(F.col(time).between(F.lit(start), F.lit(end)))


def filter_bbox(df: DataFrame, box: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows inside an inclusive range per named dimension, whatever the axis direction."""
    df = canonical_coords(df)
    for dim, (a, b) in box.items():
        dim = COORD_NAMES.get(dim.lower(), dim)
        need(df, dim)
        df = df.where(F.col(dim).between(min(a, b), max(a, b)))
    return df


def select_vars(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Coordinates plus those requested variables that exist."""
    return df.select(*present(df, COORDS), *present(df, [n for n in names if n.lower() not in COORDS]))


def canonical_coords(df: DataFrame) -> DataFrame:
    """``latitude``/``longitude`` become ``lat``/``lon``; missing attributes are filled in."""
    renames = {c: COORD_NAMES[c.lower()] for c in df.columns if c.lower() in COORD_NAMES}
    if renames:
        df = df.withColumnsRenamed(renames)
    for name, attrs in COORD_ATTRS.items():
        for f in df.schema.fields:
            if f.name == name and "long_name" not in f.metadata:
                df = df.withMetadata(name, {**f.metadata, **attrs})
    return df


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop columns without any value, then rows with a missing value."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()  # one row of counts
    kept = [c for c in df.columns if counts[c] > 0]
    return df.select(*kept).dropna()


def complete_cases(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Rows where the target and all features are present."""
    return df.dropna(subset=present(df, [target, *features]))


def choose_xy(df: DataFrame, target: str | None = None,
              features: Sequence[str] | None = None) -> tuple[str, list[str]]:
    """Names of the target and features after applying the fallbacks."""
    names = numeric_columns(df)
    if not names:
        raise ValueError("no variables to select from")
    y = present(df, [target or "kd490"])
    y = y[0] if y else names[0]
    x = [c for c in present(df, features or []) if c in names] if features is not None else []
    if not x:
        x = [c for c in names if c != y]
    return y, x


def select_xy(df: DataFrame, target: str | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """Features followed by the target under its own name."""
    y, x = choose_xy(df, target, features)
    return df.select(*[c for c in x if c != y], y)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("flags", "*_uncertainty")) -> list[str]:
    """Variables that are neither coordinates nor match an excluded name pattern."""
    skip = {*COORDS, *COORD_NAMES}
    return [c for c in df.columns if c.lower() not in skip
            and not any(fnmatch(c.lower(), p.lower()) for p in exclude)]


def filter_history(df: DataFrame, levels: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    """Records of the given levels (none = all) with at least the given confidence (0 = off)."""
    if levels:
        df = df.where(F.col("level").isin(*levels))
    if min_confidence > 0:
        df = df.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence)
    return df


def reasons(df: DataFrame) -> Column:
    """The list of range rules a sample breaks."""
    rules = [F.when(F.col("chl").isNull(), F.lit("chl missing"))]
    for name, (low, high) in SAMPLE_RANGES.items():
        if present(df, [name]):
            rules.append(F.when(F.col(name) < low, F.lit(f"{name} below {low:g}")))
            if high is not None:
                rules.append(F.when(F.col(name) > high, F.lit(f"{name} above {high:g}")))
    return F.array_compact(F.array(*rules))


def validate_samples(df: DataFrame) -> DataFrame:
    """Add ``reasons``; an empty list marks a valid sample."""
    need(df, "chl")
    return df.withColumn("reasons", reasons(df))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid samples, and rejected ones with their reasons."""
    checked = validate_samples(df)
    good = checked.where(F.size("reasons") == 0).drop("reasons")
    return good, checked.where(F.size("reasons") > 0)


def blank_zeros(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Optional inputs that are not above zero count as absent."""
    cols = present(df, cols or [c for c in SAMPLE_RANGES if c != "chl"])
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in cols})


def extremes(df: DataFrame, var: str, q: float = 0.95) -> DataFrame:
    """Rows above the q-th percentile of ``var``."""
    cut = percentile_row(df, [var], [q])
    return df.where(F.col(var) > cut[var][0])


def every_nth(df: DataFrame, n: int, cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Every n-th point of each ordered series, starting with the first."""
    return position(df, cell, time).where(F.col("_rn") % n == 0).drop("_rn")


def recent(df: DataFrame, n: int = 100, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The n newest records, newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def page(df: DataFrame, number: int, size: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Page ``number`` (from 1) of the records, newest first."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie).desc())
    return ordered.offset((number - 1) * size).limit(size)


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest ``by``."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc()).limit(k)


def preview(df: DataFrame, k: int = 5) -> DataFrame:
    return df.limit(k)


def sort_time(df: DataFrame) -> DataFrame:
    """Total order by time, then position, by range partitioning."""
    return df.orderBy(*present(df, COORDS))


def distinct_ordered(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order."""
    first = F.min_by(F.struct(*df.columns), F.col(order))
    return df.groupBy(key).agg(first.alias("_row")).select("_row.*")
