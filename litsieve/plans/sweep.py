"""Curves, grids and tuning: metrics over values of one or more parameters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators.bayes import Variant, naive_bayes
from litsieve.operators.knn import knn_votes
from litsieve.operators.metrics import best_parameters, confusion_metrics, contingency, rounded, series
from litsieve.operators.nested_knn import nested_votes
from litsieve.operators.split import fold_column
from litsieve.operators.svm import svm_predictions, svm_tallies
from litsieve.operators.terms import tally
from litsieve.plans.dataset import Dataset, VectorSet, nested_vectors, vectors
from litsieve.session import drop_scratch, materialize, scratch_mark

# The points of each curve.
FRACTIONS = (
    0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09,
    0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0,
)
LEVELS = (0.8, 0.85, 0.9, 0.92, 0.93, 0.95, 0.98, 0.99)
FULL_TEXT_LEVELS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
COSTS = (0.1, 0.5, 1, 2, 3, 4, 5)
FULL_TEXT_COSTS = (11.5, 11.7, 12, 12.2, 12.5)
GAMMAS = (1e-4, 1e-3, 0.002, 0.005, 0.006, 0.007)
FULL_TEXT_GAMMAS = (1e-5, 5e-5, 7e-5, 8e-5, 1e-4, 2e-4, 5e-4, 1e-3)
GRID_COSTS = (0.1, 0.5, 0.8, 0.9, 1, 2)
GRID_GAMMAS = (0.0005, 0.001, 0.005, 0.01)
NEIGHBOURS = (1, 3, 5, 7, 9)
TUNE_COSTS = (0.01, 0.1, 1, 10)
TUNE_GAMMAS = (0.001, 0.1, 1, 10)
TUNE_LEVELS = (0.8, 0.9, 0.95, 0.99)


def is_train() -> Column:
    return F.col("split") == "train"


def train_rows(data: Dataset) -> Dataset:
    """The train rows alone, for tuning that must not see the rows it is judged on."""
    return Dataset(data.docs.filter(is_train()), data.counts.filter(is_train()), data.weight)


def by_point(predictions: DataFrame, *params: str, weight: str | None = None) -> DataFrame:
    """Metrics per parameter point and split."""
    return confusion_metrics(contingency(predictions, (*params, "split"), weight))


def prefix_sizes(docs: DataFrame, fractions: Sequence[float], weight: str | None = None) -> list[int]:
    """Rows in each prefix: the x axis of a learning curve."""
    row = docs.agg(*(tally(F.col("h") < f, weight).alias(f"n{i}") for i, f in enumerate(fractions))).first()
    return list(row)


def nb_predictions(data: Dataset, level: float, fit_scope: str = "all") -> DataFrame:
    return naive_bayes(data.docs, data.counts, {"t": is_train()}, [Variant({}, "t", level)], fit_scope, data.weight)


def nb_feature_curve(data: Dataset, levels: Sequence[float] = LEVELS) -> DataFrame:
    """All levels share the train counts; only the terms that take part differ."""
    points = [Variant({"xvar": float(s)}, "t", s) for s in levels]
    found = naive_bayes(data.docs, data.counts, {"t": is_train()}, points, weight=data.weight)
    return by_point(found, "xvar", weight=data.weight)


def nb_learning_curve(
    data: Dataset, level: float = 0.99, fractions: Sequence[float] = FRACTIONS
) -> DataFrame:
    """All prefixes in one pass over the rows; ``xvar`` is the row count of all three splits."""
    sizes = prefix_sizes(data.docs, fractions, data.weight)
    trains = {f"t{i}": is_train() & (F.col("h") < f) for i, f in enumerate(fractions)}
    points = [
        Variant({"fraction": float(f), "xvar": float(sizes[i])}, f"t{i}", level, F.col("h") < f)
        for i, f in enumerate(fractions)
    ]
    found = naive_bayes(data.docs, data.counts, trains, points, weight=data.weight)
    return by_point(found, "fraction", "xvar", weight=data.weight)


def knn_predictions(rows: VectorSet | DataFrame, ks: Sequence[int], **options) -> DataFrame:
    """Train rows vote for all rows, train rows included."""
    frame = rows.rows if isinstance(rows, VectorSet) else rows
    weight = rows.weight if isinstance(rows, VectorSet) else None
    votes = knn_votes(
        frame.select("doc_id", "idx", "val"),
        frame.filter(is_train()).select("doc_id", "flag", "idx", "val", *([weight] if weight else [])),
        ks,
        weight=weight,
        **options,
    )
    return frame.drop("idx", "val").join(votes.drop("subset"), "doc_id")


def _model_metrics(model: str, rows: VectorSet, cost, gamma, k) -> DataFrame:
    if model == "kNN":
        predictions = knn_predictions(rows, [k])
    else:
        point = [{"cost": cost, "gamma": gamma}]
        predictions = svm_predictions(rows.rows, rows.n_features, point, is_train())
    return confusion_metrics(contingency(predictions, weight=rows.weight))


def _level_metrics(data: Dataset, level: float, model: str, cost, gamma, k) -> DataFrame:
    """One point of a feature curve, written at once; the level's vectors and search tables go before the next level."""
    spark = data.docs.sparkSession
    since = scratch_mark()
    found = _at(level, _model_metrics(model, vectors(data, level), cost, gamma, k))
    until = scratch_mark()
    found = materialize(found, "curve-point")
    drop_scratch(spark, since, until)
    return found


def _at(xvar: float, metrics: DataFrame) -> DataFrame:
    return metrics.select(F.lit(float(xvar)).alias("xvar"), "*")


def curve_metrics(
    data: Dataset,
    curve: str,
    model: str = "SVM",
    values: Sequence[float] | None = None,
    level: float = 0.92,
    cost: float = 2,
    gamma: float = 0.002,
    k: int = 1,
) -> DataFrame:
    """(xvar, split, counts, metrics) for ``learning_curve``, ``feature_curve``, ``cost_curve``,
    ``gamma_curve`` or ``k_curve`` of model ``NB``, ``kNN`` or ``SVM``."""
    if model == "NB":
        if curve == "feature_curve":
            return nb_feature_curve(data, values or LEVELS)
        if curve == "learning_curve":
            return nb_learning_curve(data, level, values or FRACTIONS).drop("fraction")
        raise ValueError(f"naive Bayes has no {curve}")
    if curve == "feature_curve" and model == "kNN":
        return knn_feature_curve(data, values or LEVELS, k)
    if curve == "feature_curve":
        return reduce(DataFrame.unionByName, [_level_metrics(data, s, model, cost, gamma, k) for s in values or LEVELS])
    rows = vectors(data, level)
    if curve == "learning_curve" and model == "SVM":
        return svm_learning_curve(data, rows, values or FRACTIONS, cost, gamma)
    if curve == "learning_curve":
        return knn_learning_curve(data, rows, values or FRACTIONS, k)
    if curve == "k_curve" and model == "kNN":
        found = knn_predictions(rows, [int(v) for v in values or NEIGHBOURS])
        return by_point(found.withColumn("xvar", F.col("k").cast("double")), "xvar", weight=rows.weight)
    if curve in ("cost_curve", "gamma_curve") and model == "SVM":
        axis = curve.removesuffix("_curve")
        fixed = {"cost": cost, "gamma": gamma}
        points = [{**fixed, axis: v} for v in values or {"cost": COSTS, "gamma": GAMMAS}[axis]]
        found = svm_predictions(rows.rows, rows.n_features, points, is_train())
        return by_point(found.withColumn("xvar", F.col(axis)), "xvar")
    raise ValueError(f"no {curve} for {model}")


def knn_feature_curve(data: Dataset, levels: Sequence[float], k: int) -> DataFrame:
    """All levels from one search, as their vocabularies are nested; written at once, vectors and search tables go."""
    spark = data.docs.sparkSession
    points = sorted(levels)
    since = scratch_mark()
    rows, sizes = nested_vectors(data, points)
    train = F.coalesce(is_train(), F.lit(False)).alias("train")
    kept = ["doc_id", "flag", "idx", "val", *([rows.weight] if rows.weight else [])]
    votes = nested_votes(rows.rows.select(*kept, train), sizes, k, rows.weight)
    xvar = F.get(F.array(*(F.lit(float(s)) for s in points)), F.col("subset"))
    found = rows.rows.drop("idx", "val").join(votes, "doc_id").withColumn("xvar", xvar)
    found = by_point(found, "subset", "xvar", weight=rows.weight).drop("subset")
    until = scratch_mark()
    found = materialize(found, "curve-points")
    drop_scratch(spark, since, until)
    return found


def svm_learning_curve(data: Dataset, rows: VectorSet, fractions: Sequence[float], cost: float, gamma: float) -> DataFrame:
    """All prefixes fitted side by side on features that are scaled by the longest prefix's train rows."""
    sizes = _filled_prefixes(data, fractions)
    trains = [is_train() & (F.col("h") < f) for f, _ in sizes]
    found = svm_predictions(rows.rows, rows.n_features, [{"cost": cost, "gamma": gamma}], trains)
    return _by_prefix(found, sizes)


def knn_learning_curve(data: Dataset, rows: VectorSet, fractions: Sequence[float], k: int) -> DataFrame:
    """All prefixes from one search: the nearest rows of each prefix are taken from the same distances."""
    sizes = _filled_prefixes(data, fractions)
    inside = rows.rows.filter(F.col("h") < max((f for f, _ in sizes), default=0.0))
    first = sum((F.when(F.col("h") >= f, 1).otherwise(0) for f, _ in sizes), F.lit(0))
    kept = ["doc_id", "flag", "idx", "val", *([rows.weight] if rows.weight else [])]
    votes = knn_votes(
        inside.select("doc_id", "idx", "val"),
        inside.filter(is_train()).select(*kept, first.alias("first")),
        [k],
        weight=rows.weight,
        subsets=max(1, len(sizes)),
    )
    return _by_prefix(inside.drop("idx", "val").join(votes, "doc_id"), sizes, rows.weight)


def _filled_prefixes(data: Dataset, fractions: Sequence[float]) -> list[tuple[float, int]]:
    """(fraction, rows) of the prefixes that hold rows, by size."""
    points = sorted(fractions)
    return [(f, n) for f, n in zip(points, prefix_sizes(data.docs, points, data.weight)) if n > 0]


def _by_prefix(found: DataFrame, sizes: Sequence[tuple[float, int]], weight: str | None = None) -> DataFrame:
    """Metrics over the rows of each prefix; prefixes of equal size stay apart."""
    at = lambda k: F.get(F.array(*(F.lit(float(s[k])) for s in sizes)).cast("array<double>"), F.col("subset"))
    own = found.withColumn("xvar", at(1)).filter(F.col("h") < at(0))
    return by_point(own, "subset", "xvar", weight=weight).drop("subset")


def evaluate(data: Dataset, curve: str, model: str = "SVM", **options) -> DataFrame:
    """Long series (xvar, variable, value): nine rows per point."""
    return series(curve_metrics(data, curve, model, **options))


def cost_gamma_metrics(
    data: Dataset, level: float = 0.92, costs: Sequence[float] = GRID_COSTS, gammas=GRID_GAMMAS
) -> DataFrame:
    rows = vectors(data, level)
    points = [{"cost": c, "gamma": g} for g in gammas for c in costs]
    found = svm_predictions(rows.rows, rows.n_features, points, is_train())
    return by_point(found, "cost", "gamma")


def _fold_numbers(k: int) -> list[int]:
    return list(range(k)) if k > 0 else [0]


def _fold_column(k: int):
    """Folds of the rows; with k = 0 fold 0 is the first 20 % of the shuffled rows."""
    return fold_column(k) if k > 0 else F.when(F.col("h") < 0.2, 0).otherwise(1)


def _mean_over_folds(metrics: DataFrame, *params: str) -> DataFrame:
    names = ("sensitivity", "specificity", "balanced_accuracy")
    return metrics.groupBy(*params).agg(*(F.avg(m).alias(m) for m in names))


def tune_naive_bayes(data: Dataset, levels: Sequence[float] = TUNE_LEVELS, kfold: int = 0) -> DataFrame:
    """Mean validation metrics per sparse level, all levels and folds in one pass."""
    fold = _fold_column(kfold)
    trains = {f"f{f}": fold != f for f in _fold_numbers(kfold)}
    points = [
        Variant({"sparselevel": float(s), "fold": f}, f"f{f}", s, fold == f)
        for s in levels
        for f in _fold_numbers(kfold)
    ]
    found = naive_bayes(data.docs, data.counts, trains, points, weight=data.weight)
    return _mean_over_folds(confusion_metrics(contingency(found, ("sparselevel", "fold"), data.weight)), "sparselevel")


def tune_svm(
    data: Dataset,
    levels: Sequence[float] = TUNE_LEVELS,
    costs: Sequence[float] = TUNE_COSTS,
    gammas: Sequence[float] = TUNE_GAMMAS,
    kfold: int = 0,
) -> DataFrame:
    """Mean validation metrics per (sparselevel, cost, gamma); all levels, folds and points are fitted side by side."""
    points = [{"cost": c, "gamma": g} for g in gammas for c in costs]
    parts = [vectors(data, s) for s in levels]
    trains = [_fold_column(kfold) != f for f in _fold_numbers(kfold)]
    cells = svm_tallies([(p.rows, p.n_features) for p in parts], points, trains)
    rows = [(float(levels[c["part"]]), c["cost"], c["gamma"], c["subset"], c["tp"], c["fp"], c["fn"], c["tn"]) for c in cells]
    ddl = "sparselevel double, cost double, gamma double, fold int, tp long, fp long, fn long, tn long"
    return _mean_over_folds(confusion_metrics(data.docs.sparkSession.createDataFrame(rows, ddl)), "sparselevel", "cost", "gamma")


def tuned_svm_holdout(data: Dataset, min_sensitivity: float = 0.8, **grid) -> DataFrame:
    """(sparselevel, cost, gamma, split, counts, metrics) on the test rows, with the point that is best within the train rows.

    The test rows take no part in the choice; empty when no point has ``min_sensitivity``.
    """
    names = ["sparselevel", "cost", "gamma"]
    tuned = rounded(tune_svm(train_rows(data), **grid), ("balanced_accuracy",), 9)
    best = best_parameters(tuned, names, min_sensitivity).first()
    if best is None:
        found = data.docs.filter(F.lit(False)).select("flag", "split", *(F.lit(0.0).alias(n) for n in names), F.lit(None).cast("boolean").alias("predicted"))
    else:
        rows = vectors(data, best["sparselevel"])
        found = svm_predictions(rows.rows, rows.n_features, [{"cost": best["cost"], "gamma": best["gamma"]}], is_train())
        found = found.filter(F.col("split") == "test").withColumn("sparselevel", F.lit(best["sparselevel"]))
    return by_point(found, *names)
