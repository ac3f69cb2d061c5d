"""Derived ocean features: pure column expressions, and differences along axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.frames import CELL, COORDS, need, over_series, present, time_number
from gridspark.operators.filters import complete_cases

# Default features of the two feature tables and the interaction pairs.
FEATURES = ("chl", "kd490", "zsd", "euphotic_depth", "sst", "sss", "current_speed",
            "day_of_year", "month", "season_sin", "season_cos")
SHORT_FEATURES = ("chl", "kd490", "zsd", "euphotic_depth", "day_of_year", "month", "season", "abs_latitude")
INTERACTIONS = (("chl", "kd490"), ("chl", "euphotic_depth"), ("sst", "chl"), ("current_speed", "chl"))
POLYNOMIAL = ("chl", "kd490", "sst")
BASIC = ("chl", "kd490", "zsd", "sst", "sss")
GRADIENTS = ("chl", "sst", "kd490")
LIGHT = 4.605
YEAR = 365.25


def euphotic_depth(kd: str = "kd490") -> Column:
    """Depth of 1 % light; NULL where the attenuation is zero."""
    return F.try_divide(F.lit(LIGHT), F.col(kd))


def euphotic_depth_clipped(kd: str = "kd490") -> Column:
    """Depth of 1 % light within 0..200; a missing attenuation gives 0 and a zero one 200."""
    k = F.col(kd)
    z = F.lit(LIGHT) / F.nullif(k, F.lit(0.0))
    return (F.when(k == 0, 200.0).when(k.isNull() | (z <= 0), 0.0)
            .when(z < 200, z).otherwise(200.0))


def specific_absorption(kd: str = "kd490", chl: str = "chl") -> Column:
    return F.try_divide(F.col(kd), F.col(chl) + 0.01)


def clarity_index(zsd: str = "zsd") -> Column:
    return F.try_divide(F.lit(1.0), F.col(zsd) + 0.1)


def current_energy(speed: str = "current_speed") -> Column:
    return 0.5 * F.col(speed) * F.col(speed)


def day_of_year(time: str = "time") -> Column:
    return F.dayofyear(time)


def month(time: str = "time") -> Column:
    return F.month(time)


def season_sin(doy: Column) -> Column:
    return F.sin(2 * F.pi() * doy / YEAR)


def season_cos(doy: Column) -> Column:
    return F.cos(2 * F.pi() * doy / YEAR)


def season(time: str = "time") -> Column:
    """1 = Dec-Feb ... 4 = Sep-Nov."""
    return F.floor((F.month(time) % 12 + 3) / 3).cast("int")


def abs_latitude(lat: str = "lat") -> Column:
    return F.abs(F.col(lat))


def chl_per_depth(chl: str = "chl", depth: str = "euphotic_depth") -> Column:
    return F.try_divide(F.col(chl), F.col(depth) + 0.1)


def productivity(method: str = "vgpm") -> Column:
    """Simple proxies of primary productivity."""
    if method == "vgpm":
        return F.col("chl") * 1000.0
    if method == "cafe":
        return F.col("chl") * F.col("sst") * 50.0
    raise ValueError(f"unknown productivity method '{method}'")


def ts_gradient(df: DataFrame, cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Size of the step in temperature and salinity since the previous time step."""
    w = over_series(cell, time)
    dt = F.col("sst") - F.lag("sst").over(w)
    ds = F.col("sss") - F.lag("sss").over(w)
    return df.withColumn("ts_gradient_magnitude", F.sqrt(dt * dt + ds * ds))


def differentiate(df: DataFrame, cols: Sequence[str], dim: str, suffix: str | None = None) -> DataFrame:
    """Second-order derivative estimate along one axis, one-sided at the ends.

    Needs a dense grid: neighbours are the previous and next row of the axis.
    """
    rest = [c for c in present(df, COORDS) if c != dim]
    w = Window.partitionBy(*rest).orderBy(dim)
    x = time_number(df, dim) if dim == "time" else F.col(dim)
    out = df.withColumns({"_hs": x - F.lag(x).over(w), "_hd": F.lead(x).over(w) - x,
                          **{f"_b_{c}": F.lag(c).over(w) for c in cols},
                          **{f"_f_{c}": F.lead(c).over(w) for c in cols}})
    hs, hd = F.col("_hs"), F.col("_hd")

    def slope(c: str) -> Column:
        b, v, f = F.col(f"_b_{c}"), F.col(c), F.col(f"_f_{c}")
        inner = (hs * hs * f + (hd * hd - hs * hs) * v - hd * hd * b) / (hs * hd * (hs + hd))
        return (F.when(hs.isNull(), (f - v) / hd).when(hd.isNull(), (v - b) / hs)
                .when(hs == hd, (f - b) / (2 * hs)).otherwise(inner))

    suffix = suffix or f"_{dim}_gradient"
    return (out.withColumns({f"{c}{suffix}": slope(c) for c in cols})
            .drop("_hs", "_hd", *[f"_{s}_{c}" for s in "bf" for c in cols]))


def spatial_gradients(df: DataFrame, cols: Sequence[str] = GRADIENTS) -> DataFrame:
    cols = present(df, cols)
    return differentiate(differentiate(df, cols, "lat"), cols, "lon")


def derive_features(df: DataFrame, gradients: bool = True) -> DataFrame:
    """All derived features whose inputs exist."""
    has = lambda *names: len(present(df, names)) == len(names)
    new: dict[str, Column] = {}
    if has("kd490"):
        new["euphotic_depth"] = euphotic_depth()
    if has("chl", "kd490"):
        new["chl_specific_absorption"] = specific_absorption()
    if has("zsd"):
        new["clarity_index"] = clarity_index()
    if has("current_speed"):
        new["current_energy"] = current_energy()
    if has("time"):
        doy = day_of_year()
        new |= {"day_of_year": doy, "month": month(), "season_sin": season_sin(doy), "season_cos": season_cos(doy)}
    out = df.withColumns(new)
    if has("chl", "kd490"):
        out = out.withColumn("chl_per_euphotic_depth", chl_per_depth())
    if has("sst", "sss", *COORDS):
        out = ts_gradient(out)
    if gradients and has(*COORDS):
        out = spatial_gradients(out)
    return out


def interactions(df: DataFrame, available: Sequence[str] | None = None) -> DataFrame:
    """Products of the interaction pairs of which both members exist."""
    names = present(df, available or df.columns)
    pairs = [(a, b) for a, b in INTERACTIONS if a in names and b in names]
    return df.withColumns({f"{a}_{b}_interaction": F.col(a) * F.col(b) for a, b in pairs})


def polynomials(df: DataFrame, cols: Sequence[str] = POLYNOMIAL) -> DataFrame:
    new = {}
    for c in present(df, cols):
        new[f"{c}_squared"] = F.col(c) * F.col(c)
        new[f"{c}_cubic"] = F.col(c) * F.col(c) * F.col(c)
    return df.withColumns(new)


def feature_dataset(df: DataFrame, target: str = "pp") -> DataFrame:
    """Basic variables, clipped euphotic depth, target, calendar and position features."""
    new = {"euphotic_depth": euphotic_depth_clipped()} if present(df, ["kd490"]) else {}
    if not present(df, [target]):
        need(df, "chl")
        new[target] = productivity()
    basic = [c for c in present(df, BASIC) if c.lower() != target.lower()]
    depth = [c for c in new if c != target]
    out = df.withColumns(new).select(*present(df, COORDS), *basic, *depth, target)
    return out.withColumns({"day_of_year": day_of_year(), "month": month(), "season": season(),
                            "abs_latitude": abs_latitude()})


def ml_table(df: DataFrame, target: str = "pp", features: Sequence[str] = FEATURES,
             with_interactions: bool = True, with_polynomials: bool = False) -> DataFrame:
    """Complete rows of the available features, their products and powers, and the target."""
    need(df, target)
    names = present(df, features)
    out = df.select(*[c for c in present(df, COORDS)], *names, *[t for t in [target] if t not in names])
    if with_interactions:
        out = interactions(out, names)
    if with_polynomials:
        out = polynomials(out, [c for c in POLYNOMIAL if c in names])
    x = [c for c in out.columns if c not in COORDS and c != target]
    return complete_cases(out, target, x)
