"""Pollution index, level labels and rule scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.frames import bind, need, one_of, one_row
from gridspark.functions.quantiles import percentile_row

CLASSES = ("LOW", "MEDIUM", "HIGH")

# Indicator weights of the pollution index.
INDEX_WEIGHTS = {"CHL": 0.30, "KD490": 0.25, "PP": 0.20, "CDM": 0.15, "BBP": 0.10}

# Upper cuts of chlorophyll per scheme.
THRESHOLDS = {
    "api": (1.0, 3.0),
    "series": (1.0, 5.0),
    "map": (0.0, 1.0, 3.0, 100.0),
    "four": (1.0, 5.0, 20.0),
    "closed": (1.0, 5.0),
}

# Confidence and probabilities (LOW, MEDIUM, HIGH) of the rule score.
RULE_SCORES = {
    "LOW": (0.85, (0.7, 0.2, 0.1)),
    "MEDIUM": (0.75, (0.2, 0.6, 0.2)),
    "HIGH": (0.80, (0.1, 0.3, 0.6)),
}


def index_weights(cols: Sequence[str]) -> dict[str, float]:
    """Weight of each column found for an indicator, normalised to 1.

    An indicator takes the column of its name, else the first containing it; without any
    hit all columns weigh the same.
    """
    found: dict[str, float] = {}
    for name, weight in INDEX_WEIGHTS.items():
        exact = [c for c in cols if c.upper() == name]
        similar = exact or [c for c in cols if name in c.upper()]
        if similar:
            found[similar[0]] = weight
    if not found:
        found = {c: 1.0 / len(cols) for c in cols}
    total = sum(found.values())
    return {c: w / total for c, w in found.items()}


def pollution_index(df: DataFrame, cols: Sequence[str], out: str = "pollution_index") -> DataFrame:
    """Weighted sum of min-max scaled indicators; a constant column adds 0 and keeps its weight."""
    weights = index_weights(cols)
    held, row = bind(df, one_row(df, **{f"lo_{c}": F.min(c) for c in weights},
                                 **{f"hi_{c}": F.max(c) for c in weights}))
    total = F.lit(0.0)
    for c, w in weights.items():
        width = row[f"hi_{c}"] - row[f"lo_{c}"]
        total = total + F.when(width > 0, (F.col(c) - row[f"lo_{c}"]) / width * w).otherwise(F.lit(0.0))
    return held.withColumn(out, total).drop("_row")


def label_by_percentile(df: DataFrame, var: str, low: float = 0.33, high: float = 0.66,
                        out: str = "label") -> DataFrame:
    """0 up to the low percentile, 1 up to the high one, 2 above."""
    held, cut = bind(df, percentile_row(df, [var], [low, high]))
    v = F.col(var)
    label = F.when(v > cut[var][1], 2).when(v > cut[var][0], 1).when(v.isNotNull(), 0)
    return held.withColumn(out, label.cast("int")).drop("_row")


def level(chl: Column, scheme: str = "api") -> Column:
    """Level name of a chlorophyll value under a scheme.

    ``api``, ``series`` and ``four`` are open above each cut, ``closed`` includes it, and
    ``map`` uses right-closed bins and leaves values outside (0, 100] without a level.
    """
    one_of(scheme, THRESHOLDS, "threshold scheme")
    cuts = THRESHOLDS[scheme]
    if scheme == "map":
        return (F.when((chl > cuts[0]) & (chl <= cuts[1]), "LOW").when((chl > cuts[1]) & (chl <= cuts[2]), "MEDIUM")
                .when((chl > cuts[2]) & (chl <= cuts[3]), "HIGH"))
    if scheme == "closed":
        return F.when(chl <= cuts[0], "LOW").when(chl <= cuts[1], "MEDIUM").when(chl.isNotNull(), "HIGH")
    names = (*CLASSES, "CRITICAL")
    out = F.when(chl < cuts[0], names[0])
    for i in range(1, len(cuts)):
        out = out.when(chl < cuts[i], names[i])
    return out.when(chl.isNotNull(), names[len(cuts)])


def label_by_threshold(df: DataFrame, scheme: str = "api", chl: str = "chl", out: str = "level") -> DataFrame:
    need(df, chl)
    return df.withColumn(out, level(F.col(chl), scheme))


def score_rules(df: DataFrame, chl: str = "chl") -> DataFrame:
    """Level, confidence and probabilities from chlorophyll alone; NULL without it."""
    out = label_by_threshold(df, "api", chl)
    lv = F.col("level")
    conf, probs = F.lit(None).cast("double"), F.lit(None).cast("map<string,double>")
    for name, (c, p) in RULE_SCORES.items():
        conf = F.when(lv == name, F.lit(c)).otherwise(conf)
        pairs = [F.lit(x) for kv in zip(CLASSES, p) for x in kv]
        probs = F.when(lv == name, F.create_map(*pairs)).otherwise(probs)
    return out.withColumns({"confidence": conf, "probabilities": probs})


def risk_level(level_col: Column | str = "level", confidence: Column | str = "confidence") -> Column:
    """``<LEVEL>_RISK``, UNKNOWN for other names; marked when confidence is below 0.7."""
    lv = F.col(level_col) if isinstance(level_col, str) else level_col
    cf = F.col(confidence) if isinstance(confidence, str) else confidence
    base = F.when(lv.isin(*CLASSES, "CRITICAL"), F.concat(lv, F.lit("_RISK"))).otherwise(F.lit("UNKNOWN"))
    return F.when(cf < 0.7, F.concat(base, F.lit("_LOW_CONFIDENCE"))).otherwise(base)


def encode_labels(df: DataFrame, col: str = "level", out: str = "code",
                  names: Sequence[str] | None = None) -> DataFrame:
    """Codes in alphabetical order of the labels, from 0.

    The distinct labels are a short array; unknown or missing labels get NULL.
    """
    if names is not None:
        known = F.array(*[F.lit(x) for x in sorted(names)])
    else:
        known = df.agg(F.sort_array(F.collect_set(col))).scalar()
    held, row = bind(df, F.array_position(known, F.col(col)))
    return held.withColumn(out, F.when(row > 0, (row - 1).cast("int"))).drop("_row")


def decode_labels(df: DataFrame, names: Sequence[str], col: str = "code", out: str = "level") -> DataFrame:
    known = F.array(*[F.lit(x) for x in sorted(names)])
    return df.withColumn(out, F.get(known, F.col(col)))
