"""Batch scoring: from samples to levels, rejected rows and statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from gridspark.operators.filters import split_valid
from gridspark.operators.labels import CLASSES
from gridspark.operators.scoring import score_or_rules
from gridspark.operators.stats import batch_stats, level_counts
from gridspark.plans.cleaning import written


@dataclass(frozen=True)
class ScoredBatch:
    scored: DataFrame
    rejected: DataFrame
    levels: DataFrame
    stats: DataFrame


def score_batch(samples: DataFrame, model: PipelineModel | None = None, features: Sequence[str] = (),
                medians: Mapping[str, float] | None = None, classes: Sequence[str] = CLASSES,
                stage: Callable[[DataFrame, str], DataFrame] = written) -> ScoredBatch:
    """Set invalid samples aside with their reasons, score the others, count levels and successes.

    Scores are written once; both summaries read them from there.
    """
    good, rejected = split_valid(samples)
    scored = stage(score_or_rules(good, model, features, medians, classes), "scored")
    return ScoredBatch(scored, rejected, level_counts(scored), batch_stats(scored))
