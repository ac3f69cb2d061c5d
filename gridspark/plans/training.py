"""Training: from grids to a classifier of pollution levels with its reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from gridspark.functions.frames import COORDS, present
from gridspark.operators.align import lookup_by_coords
from gridspark.operators.labels import CLASSES, label_by_percentile, pollution_index
from gridspark.operators.missing import keep_and_fill
from gridspark.operators.ml import classification_report, cross_validate, importance, overfit_flag, train_classifier
from gridspark.operators.sampling import sample_cells, split_stratified
from gridspark.plans.cleaning import written
from gridspark.sources.sinks import feature_stats, save_model, write_stats


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    features: tuple[str, ...]
    rows: DataFrame
    report: DataFrame
    overfit: DataFrame
    importance: DataFrame
    stats: DataFrame
    folds: DataFrame | None


def train(grids: Sequence[DataFrame], features: Sequence[str], indicators: Sequence[str], reference: str = "chl",
          n: int = 50_000, trees: int | None = None, max_depth: int = 15, folds: int = 5, seed: int = 42,
          folder: str | None = None, stage: Callable[[DataFrame, str], DataFrame] = written) -> Trained:
    """Sample cells of the first grid, look up the others, fill, label, split, fit and judge a forest.

    ``reference`` must be present in a sampled cell.  Variables with too few values are left out, of the index too.
    ``folds=0`` leaves out the cross-validation.  With ``folder`` the model and the statistics are saved there.
    The sampled cells are written before the fill looks at them, and the split rows before trees pass over them.
    """
    first, *others = grids
    cells = lookup_by_coords(sample_cells(first, reference, n, seed), others)
    cells = stage(cells.select(*COORDS, *present(cells, features)), "training_cells")
    full = keep_and_fill(cells, present(cells, features))
    names = present(full, features)
    marked = label_by_percentile(pollution_index(full, present(full, indicators)), "pollution_index")
    rows = stage(split_stratified(marked, "label", COORDS, seed=seed), "training_rows")
    fit, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = train_classifier(fit, names, trees=trees, max_depth=max_depth, seed=seed)
    scored = model.transform(test)
    stats = feature_stats(rows, names)
    if folder:
        save_model(model, folder, names, CLASSES, rows.sparkSession)
        write_stats(stats, f"{folder}/stats")
    return Trained(model, tuple(names), rows, classification_report(scored), overfit_flag(model.transform(fit), scored),
                   importance(model, names), stats, cross_validate(fit, names, k=folds) if folds else None)
