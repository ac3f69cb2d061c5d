"""Missing values: fills in time, in space and from rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import CELL, bind, need, one_of, one_row, over_series, present, time_number
from gridspark.functions.quantiles import percentile_row
from gridspark.operators.align import fill_spatial_nearest
from gridspark.operators.series import in_blocks, next_valid, plain_next_valid

LIMIT = 3

# Plankton groups whose share of chlorophyll has a default.
PHYTOPLANKTON = ("DIATO", "DINO", "GREEN", "HAPTO", "MICRO", "NANO", "PICO", "PROCHLO", "PROKAR")


class Default(NamedTuple):
    """A missing feature is ``base + slope * chlorophyll`` if its name matches.

    ``names`` must equal the name if ``exact``, else occur in it; ``uncertainty`` tells
    whether the name must (True) or must not (False) speak of uncertainty.
    """

    names: tuple[str, ...]
    base: float
    slope: float
    exact: bool = False
    uncertainty: bool | None = None

    def matches(self, name: str) -> bool:
        hit = name in self.names if self.exact else any(n in name for n in self.names)
        return hit and self.uncertainty in (None, "UNCERTAINTY" in name)


# Defaults per variant, the first match counts.
DEFAULTS = {
    "cli": (
        Default(("CHL",), 0.0, 1.0, uncertainty=False),
        Default(("CHL",), 0.0, 0.1, uncertainty=True),
        Default(("PP",), 0.0, 100.0, exact=True),
        Default(("PP_",), 0.0, 100.0),
        Default(("KD",), 0.1, 0.05),
        Default(PHYTOPLANKTON, 0.0, 0.01, uncertainty=False),
        Default(PHYTOPLANKTON, 0.0, 0.005, uncertainty=True),
        Default(("CDM",), 0.01, 0.002, exact=True),
        Default(("BBP",), 0.001, 0.0003, exact=True),
    ),
    "api": (
        Default(("CHL",), 0.0, 1.0, uncertainty=False),
        Default(("PP",), 0.0, 100.0),
        Default(("KD",), 0.1, 0.05),
        Default(("DIATO", "DINO"), 0.0, 0.01),
        Default(("CDM",), 0.01, 0.002),
        Default(("BBP",), 0.001, 0.0003),
    ),
}


def ffill(df: DataFrame, cols: Sequence[str], limit: int = LIMIT,
          cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Carry the last valid value forward over at most ``limit`` steps."""
    w = over_series(cell, time).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def bfill(df: DataFrame, cols: Sequence[str], limit: int = LIMIT,
          cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Carry the next valid value back over at most ``limit`` steps."""
    w = over_series(cell, time).rowsBetween(0, limit)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in cols})


def interpolate_time(df: DataFrame, cols: Sequence[str], limit: int = LIMIT,
                     cell: Sequence[str] = CELL, time: str = "time", long_series: bool = False) -> DataFrame:
    """Linear in true time between valid neighbours.

    Only the first ``limit`` steps of a gap are filled, and nothing before the first
    or after the last valid value.  ``long_series`` keeps single cells with very many
    steps out of one task.
    """
    now = time_number(df, time)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(now.alias("t"), F.col(c).alias("v"))) for c in cols}

    def look_back(d: DataFrame, keys: Sequence[str]) -> DataFrame:
        behind = over_series(keys, time).rowsBetween(-limit, -1)
        return d.withColumns({f"_p_{c}": F.last(known[c], ignorenulls=True).over(behind) for c in cols})

    if long_series:
        out = next_valid(in_blocks(df, look_back, limit, cell, time), cols, cell, time)
    else:
        out = plain_next_valid(look_back(df, cell), cols, cell, time)

    def between(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        line = p["v"] + (n["v"] - p["v"]) * (now - p["t"]) / (n["t"] - p["t"])
        return F.coalesce(F.col(c), line)

    return (out.withColumns({c: between(c) for c in cols})
            .drop(*[f"_{side}_{c}" for side in "pn" for c in cols]))


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    held, row = bind(df, one_row(df, **{c: F.avg(c) for c in cols}))
    return held.withColumns({c: F.coalesce(F.col(c), row[c]) for c in cols}).drop("_row")


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    held, row = bind(df, percentile_row(df, cols, [0.5]))
    return held.withColumns({c: F.coalesce(F.col(c), row[c][0]) for c in cols}).drop("_row")


def fill_slice_mean(df: DataFrame, cols: Sequence[str], time: str = "time") -> DataFrame:
    """Mean of the same time slice, pre-aggregated so that no slice sits in one task."""
    means = df.groupBy(time).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, time, "left")
    return (out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols})
            .select(*df.columns))


def fill_missing(df: DataFrame, cols: Sequence[str], method: str = "interpolate",
                 limit: int | None = None, min_valid: int = 10) -> DataFrame:
    """Fill ``cols`` by one of the named methods; ``limit`` 0 or None means 3 steps."""
    limit = limit or LIMIT
    cols = present(df, cols)
    if method == "interpolate":
        out = interpolate_time(df, cols, limit)
        return fill_spatial_nearest(out, cols, min_valid).select(*df.columns)
    if method == "ffill":
        return ffill(df, cols, limit)
    if method == "bfill":
        return bfill(df, cols, limit)
    if method == "mean":
        return fill_mean(df, cols)
    if method == "median":
        return fill_median(df, cols)
    if method == "knn":
        return fill_slice_mean(df, cols)
    raise ValueError(f"unknown fill method '{method}'")


def keep_and_fill(df: DataFrame, cols: Sequence[str], min_valid: float = 0.3) -> DataFrame:
    """Keep variables with a valid share above ``min_valid`` and fill their gaps with the median."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols]).first()
    kept = [c for c in cols if counts["_n"] and counts[c] / counts["_n"] > min_valid]
    out = df.select(*[c for c in df.columns if c not in cols or c in kept])
    return fill_median(out, kept) if kept else out


def fill_zero(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Absent features, whole columns or single values, become 0."""
    have = {c.lower(): c for c in df.columns}
    return df.withColumns({
        f: F.coalesce(F.col(have[f.lower()]), F.lit(0.0)) if f.lower() in have else F.lit(0.0)
        for f in features})


def impute_features(df: DataFrame, features: Sequence[str], medians: Mapping[str, float] | None = None,
                    variant: str = "cli", chl: str = "chl") -> DataFrame:
    """Every feature a model needs: given value, training median, chlorophyll rule, 0.

    Given names match regardless of case.
    """
    one_of(variant, DEFAULTS, "variant")
    need(df, chl)
    have = {c.lower(): c for c in df.columns}
    medians = {k.lower(): v for k, v in (medians or {}).items()}

    def value(f: str) -> Column:
        steps = [F.col(have[f.lower()]).cast("double")] if f.lower() in have else []
        if f.lower() in medians:
            steps.append(F.lit(float(medians[f.lower()])))
        else:
            rule = next((d for d in DEFAULTS[variant] if d.matches(f.upper())), None)
            steps += [rule.base + F.col(chl).cast("double") * rule.slope] if rule else []
        return F.coalesce(*steps, F.lit(0.0))

    return df.withColumns({f: value(f) for f in features})


def resolve_chl(pairs: Column | str, variant: str = "cli") -> Column:
    """The chlorophyll input among given (key, value) pairs, in their order.

    ``pairs`` is an array of structs ``k``, ``v``.  The first key with CHL and without
    UNCERTAINTY wins, then any key with CHL; variant ``api`` takes the first with CHL.
    """
    pairs = F.col(pairs) if isinstance(pairs, str) else pairs
    usable = F.filter(pairs, lambda p: F.upper(p["k"]).contains("CHL") & p["v"].isNotNull())
    if variant == "api":
        return F.get(usable, F.lit(0))["v"]
    sure = F.filter(usable, lambda p: ~F.upper(p["k"]).contains("UNCERTAINTY"))
    return F.coalesce(F.get(sure, F.lit(0))["v"], F.get(usable, F.lit(0))["v"])
