"""Filters and differences along time.

Frames are bounded wherever the filter is local, so every operator here works on the
series window ``partitionBy(cell).orderBy(time)`` and consecutive ones share its shuffle.
Series are expected to be dense (see ``densify``): a neighbour is the neighbouring row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.frames import CELL, COORDS, bind, one_of, one_row, over_series
from gridspark.functions.quantiles import value_ranks
from gridspark.operators.series import position, same

FILTERS = ("savgol", "moving_avg", "exponential", "median")


def _long_enough(w: WindowSpec, time: str, window: int) -> Column:
    """True where the series has at least ``window`` steps.

    Looks only ``window`` rows around: enough rows before and after, counted together.
    """
    near = w.rowsBetween(-(window - 1), window - 1)
    return F.count(time).over(near) >= window


def moving_avg(df: DataFrame, cols: Sequence[str], window: int = 7,
               cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Centred mean, NULL unless all ``window`` values are present; short series stay as they are."""
    w = over_series(cell, time)
    half = window // 2
    frame = w.rowsBetween(-half, half if window % 2 else half - 1)
    held = df.withColumns({"_enough": _long_enough(w, time, window), **{
        f"_m_{c}": F.when(F.count(c).over(frame) == window, F.avg(c).over(frame)) for c in cols}})
    return (held.withColumns({c: F.when(F.col("_enough"), F.col(f"_m_{c}")).otherwise(F.col(c)) for c in cols})
            .drop("_enough", *[f"_m_{c}" for c in cols]))


def savgol_weights(window: int, order: int) -> np.ndarray:
    """Row i holds the weights that fit a polynomial to the window and evaluate it at position i."""
    x = np.arange(window) - window // 2
    basis = np.vander(x, order + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def savgol(df: DataFrame, cols: Sequence[str], window: int = 7, order: int = 2,
           cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Savitzky-Golay filter; the ends come from the polynomial of the first or last window.

    Every neighbour is a column of its own, computed once and weighted as the row's
    place in the series demands.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and larger than the order")
    w = over_series(cell, time)
    half, reach = window // 2, window - 1
    weights = savgol_weights(window, order)

    def name(c: str, k: int) -> str:
        return c if k == 0 else f"_at_{k + reach}_{c}"

    shifts = [k for k in range(-reach, reach + 1) if k]
    held = df.withColumns({
        "_enough": _long_enough(w, time, window),
        "_before": F.count(time).over(w.rowsBetween(-half, -1)),  # rows before, at most half
        "_after": F.count(time).over(w.rowsBetween(1, half)),
        **{name(c, k): (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(w) for c in cols for k in shifts}})

    def fitted(c: str, pos: int) -> Column:
        # the window starts ``pos`` rows before this one
        return reduce(Column.__add__, [F.lit(float(weights[pos, i])) * F.col(name(c, i - pos))
                                       for i in range(window)])

    def smooth(c: str) -> Column:
        value = F.when(~F.col("_enough"), F.col(c))
        for i in range(half):
            value = value.when(F.col("_before") == i, fitted(c, i))
        for i in range(half):
            value = value.when(F.col("_after") == i, fitted(c, window - 1 - i))
        return value.otherwise(fitted(c, half))

    return (held.withColumns({c: smooth(c) for c in cols})
            .drop("_enough", "_before", "_after", *[name(c, k) for c in cols for k in shifts]))


def median_filter(df: DataFrame, cols: Sequence[str], window: int = 7,
                  cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Running median of an odd window, zero padded at the ends; a gap in the window gives NULL."""
    if window % 2 == 0:
        raise ValueError("the window of a median filter must be odd")
    w = over_series(cell, time)
    half = window // 2
    frame = w.rowsBetween(-half, half)
    held = df.withColumns({"_enough": _long_enough(w, time, window), "_rows": F.count(time).over(frame),
                           **{f"_v_{c}": F.collect_list(c).over(frame) for c in cols}})  # at most ``window`` values

    def middle(c: str) -> Column:
        values = F.col(f"_v_{c}")
        padded = F.concat(values, F.array_repeat(F.lit(0.0), (F.lit(window) - F.col("_rows")).cast("int")))
        med = F.element_at(F.sort_array(padded), half + 1)
        return F.when(~F.col("_enough"), F.col(c)).when(F.size(values) == F.col("_rows"), med)

    return (held.withColumns({c: middle(c) for c in cols})
            .drop("_enough", "_rows", *[f"_v_{c}" for c in cols]))


def ewm(df: DataFrame, cols: Sequence[str], span: int = 7, cell: Sequence[str] = CELL, time: str = "time",
        piece: float | None = None, rows: int | None = None) -> DataFrame:
    """Exponentially weighted mean with adjusted weights; gaps decay the weights.

    Numerator and denominator are running sums of values scaled by the inverse weights,
    within pieces of ``rows`` rows: few enough that the scale cannot overflow, and so many
    that of all earlier pieces only the last one still has weight in a DOUBLE.  A gap that
    reaches back further keeps the mean of the last valid row.
    """
    if span <= 1:
        return df
    keys = list(cell)
    decay = 1.0 - 2.0 / (span + 1.0)
    rows = rows or int(250 / -math.log10(decay))
    if decay ** rows > 1e-18:
        raise ValueError("pieces are too short for this span")
    part = [*keys, "_piece"]
    held = (position(df, keys, time, piece=piece).withColumn("_piece", F.floor(F.col("_rn") / rows))
            .withColumn("_j", F.col("_rn") % rows))
    upto = Window.partitionBy(*part).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    grow, fade = F.pow(F.lit(1 / decay), F.col("_j")), F.pow(F.lit(decay), F.col("_j"))
    for i, c in enumerate(cols):
        weight = F.when(F.col(c).isNotNull(), grow).otherwise(0.0)
        held = held.withColumns({
            f"_n{i}": F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * grow).over(upto) * fade,
            f"_d{i}": F.sum(weight).over(upto) * fade})
    sums = [f"_{x}{i}" for i in range(len(cols)) for x in "nd"]

    # one row per piece: its end state, that of the piece before, and the last mean so far
    ends = held.groupBy(*part).agg(F.count("*").alias("_len"), F.max_by(F.struct(*sums), "_j").alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_piece")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*part, "_end", F.sum("_len").over(Window.partitionBy(*keys)).alias("_total"),
                       F.lag("_end").over(order).alias("_prev"))
    whole = F.pow(F.lit(decay), F.lit(rows))

    def mean(n: Column, d: Column, i: int, faded: Column) -> Column:
        past_n, past_d = (F.coalesce(F.col(f"_prev._{x}{i}"), F.lit(0.0)) for x in "nd")
        return F.when(d > 0, (n + faded * past_n) / (d + faded * past_d))

    ends = ends.withColumns({f"_m{i}": mean(F.col(f"_end._n{i}"), F.col(f"_end._d{i}"), i, whole)
                             for i in range(len(cols))})
    ends = ends.select(*part, "_total", "_prev", *[
        F.last(f"_m{i}", ignorenulls=True).over(earlier).alias(f"_m{i}") for i in range(len(cols))])
    out = held.alias("d").join(ends.alias("s"), same("d", "s", part)).select(
        "d.*", "s._total", "s._prev", *[f"s._m{i}" for i in range(len(cols))])
    faded = F.pow(F.lit(decay), F.col("_j") + 1)

    def value(i: int, c: str) -> Column:
        smooth = F.coalesce(mean(F.col(f"_n{i}"), F.col(f"_d{i}"), i, faded), F.col(f"_m{i}"))
        return F.when(F.col("_total") >= span, smooth).otherwise(F.col(c))

    return out.withColumns({c: value(i, c) for i, c in enumerate(cols)}).select(*df.columns)


def temporal_filter(df: DataFrame, cols: Sequence[str], kind: str = "savgol", window: int = 7,
                    cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Apply one of the named filters; a column the filter would empty keeps its values."""
    one_of(kind, FILTERS, "temporal filter")
    act = {"savgol": savgol, "moving_avg": moving_avg, "exponential": ewm, "median": median_filter}
    if not cols:
        return df
    kept = df.withColumns({f"_o_{c}": F.col(c) for c in cols})
    out = act[kind](kept, cols, window, cell=cell, time=time)
    out, found = bind(out, one_row(out, **{c: F.count(c) for c in cols}))
    return (out.withColumns({c: F.when(found[c] > 0, F.col(c)).otherwise(F.col(f"_o_{c}")) for c in cols})
            .select(*df.columns))


def diff_time(df: DataFrame, cols: Sequence[str], lag: int = 1,
              cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Add ``<col>_diff``: change since ``lag`` steps before."""
    w = over_series(cell, time)
    return df.withColumns({f"{c}_diff": F.col(c) - F.lag(c, lag).over(w) for c in cols})


def axis_regularity(df: DataFrame, dims: Sequence[str] = COORDS, rtol: float = 1e-3,
                    atol: float = 1e-8) -> DataFrame:
    """Per axis: number of steps, first, smallest and largest spacing, and whether it is uniform."""
    parts = []
    for d in dims:
        kind = df.schema[d].dataType
        num = F.col(d).cast("double") if isinstance(kind, T.NumericType) else (
            F.unix_date(d).cast("double") if isinstance(kind, T.DateType)
            else F.unix_micros(F.col(d).cast("timestamp")) / 86400e6)
        points = df.select(num.alias("x")).where(F.col("x").isNotNull()).distinct()
        gaps = points.select("x", (F.lead("x").over(Window.orderBy("x")) - F.col("x")).alias("g"))
        parts.append(gaps.agg(F.lit(d).alias("dim"), F.count("*").alias("steps"),
                              F.min_by("g", F.when(F.col("g").isNotNull(), F.col("x"))).alias("first_gap"),
                              F.min("g").alias("min_gap"), F.max("g").alias("max_gap")))
    out = reduce(DataFrame.unionAll, parts)
    tol = atol + rtol * F.abs(F.col("first_gap"))
    far = F.greatest(F.abs(F.col("min_gap") - F.col("first_gap")), F.abs(F.col("max_gap") - F.col("first_gap")))
    return out.withColumn("uniform", F.coalesce(far <= tol, F.lit(True)))


def latest(df: DataFrame, cell: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """The newest row of each series, as an aggregate."""
    newest = F.max_by(F.struct(*df.columns), F.col(time))
    return df.groupBy(*cell).agg(newest.alias("_row")).select("_row.*")


#: Rational approximations of the normal quantile published as AS 241 (Wichura 1988), highest power first.
#: Central part in 0.180625 - q^2, near tails in r - 1.6 and far tails in r - 5, with r = sqrt(-ln p).
CENTRE = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
           1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
          (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077,
           687.18700749205790830, 42.313330701600911252, 1.0))
NEAR = ((7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504,
         5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
        (1.05075007164441684324e-9, 5.4759380849953449460e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1,
         1.67638483018380384940, 2.05319162663775882187, 1.0))
FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1,
        1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
       (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2,
        1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def _ratio(parts: tuple[Sequence[float], Sequence[float]], x: Column) -> Column:
    top, bottom = (reduce(lambda s, c: s * x + c, part[1:], F.lit(part[0])) for part in parts)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, in column arithmetic; NULL outside 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(NEAR, r - 1.6)).otherwise(_ratio(FAR, r - 5.0))
    z = F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), z)


def qq_points(df: DataFrame, var: str, n: int | None = None, chunk: int = 100_000) -> DataFrame:
    """Normal Q-Q points with slope, intercept and r of the line through all of them.

    The line uses every row.  All points come out, or ``n`` at evenly spaced ranks, as a plot may want.
    A value that occurs very often is cut into chunks of ranks, so its rows are spread as well.
    """
    ranks = value_ranks(df, var)
    total = one_row(df, n=F.count(var))
    last = F.floor((F.col("c") - 1) / chunk)
    pieces = ranks.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last))).hint("rebalance")
    first = F.col("start") + F.col("_k") * chunk + 1
    end = F.least(F.col("start") + F.col("c"), F.col("start") + (F.col("_k") + 1) * chunk)
    rows, size = bind(pieces.select("v", F.explode(F.sequence(first, end)).alias("i")), total)

    def place(i: Column, size: Column) -> Column:
        top = F.pow(F.lit(0.5), 1.0 / size)
        return F.when(i == size, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (size + 0.365))

    rows = rows.select("i", "v", normal_quantile(place(F.col("i"), size["n"])).alias("z"))
    fit = one_row(rows, slope=F.regr_slope("v", "z"), intercept=F.regr_intercept("v", "z"), r=F.corr("v", "z"))
    if n is None:
        points, line = bind(rows.select("i", F.col("z").alias("theoretical"), F.col("v").alias("value")), fit)
        return points.select("i", "theoretical", "value", line["slope"].alias("slope"),
                             line["intercept"].alias("intercept"), line["r"].alias("r"))

    held, size = bind(ranks, total)
    step = (size["n"] - 1) / max(n - 1, 1)
    shown = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                         lambda k: F.round(k * F.col("_step")).cast("long") + 1))
    held = held.withColumn("_step", step).withColumn("_shown", shown)
    mine = F.filter("_shown", lambda r: (r > F.col("start")) & (r <= F.col("start") + F.col("c")))
    points = held.select("v", "_row", F.explode(mine).alias("i"))
    points = points.select("i", normal_quantile(place(F.col("i"), F.col("_row.n"))).alias("theoretical"),
                           F.col("v").alias("value"))
    points, line = bind(points, fit)
    return points.select("i", "theoretical", "value", line["slope"].alias("slope"),
                         line["intercept"].alias("intercept"), line["r"].alias("r"))
