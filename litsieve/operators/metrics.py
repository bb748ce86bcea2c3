"""Contingency counts, confusion metrics and result series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators.terms import tally


def class_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def class_weights(docs: DataFrame) -> DataFrame:
    """(flag, n, weight): weight = smallest class size / own size."""
    counts = class_counts(docs)
    smallest = counts.agg(F.min("n")).scalar()
    return counts.withColumn("weight", smallest / F.col("n"))


def contingency(predictions: DataFrame, by: Sequence[str] = ("split",), weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn of ``predicted`` against ``flag`` per group; null predictions count nowhere.

    With ``weight`` a row counts as often as that column says.
    """
    predicted, actual = F.col("predicted"), F.col("flag")
    return predictions.groupBy(*by).agg(
        tally(predicted & actual, weight).alias("tp"),
        tally(predicted & ~actual, weight).alias("fp"),
        tally(~predicted & actual, weight).alias("fn"),
        tally(~predicted & ~actual, weight).alias("tn"),
    )


def _share(part: Column, whole: Column) -> Column:
    """0/0 is null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def confusion_metrics(table: DataFrame) -> DataFrame:
    """All summary metrics as columns next to the four counts; TRUE is the positive class."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    observed = _share(tp + tn, n)
    expected = _share((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sensitivity, specificity = _share(tp, tp + fn), _share(tn, tn + fp)
    gap = F.when(fp == fn, F.lit(0)).otherwise(F.abs(fp - fn) - 1)
    columns = {
        "accuracy": observed,
        "no_information_rate": _share(F.greatest(tp + fn, fp + tn), n),
        "kappa": F.try_divide(observed - expected, F.lit(1.0) - expected),
        "mcnemar": _share(gap * gap, fp + fn),
        "sensitivity": sensitivity,
        "specificity": specificity,
        "ppv": _share(tp, tp + fp),
        "npv": _share(tn, tn + fn),
        "prevalence": _share(tp + fn, n),
        "detection_rate": _share(tp, n),
        "detection_prevalence": _share(tp + fp, n),
        "balanced_accuracy": (sensitivity + specificity) / 2,
    }
    return table.select("*", *(c.alias(name) for name, c in columns.items()))


METRIC_NAMES = (
    "accuracy", "no_information_rate", "kappa", "mcnemar", "sensitivity", "specificity", "ppv",
    "npv", "prevalence", "detection_rate", "detection_prevalence", "balanced_accuracy",
)


def rounded(df: DataFrame, columns: Sequence[str] = METRIC_NAMES, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def series(metrics: DataFrame, by: Sequence[str] = ("xvar",)) -> DataFrame:
    """Long form (*by, variable, value): nine rows per point when all three splits are present."""
    wide = metrics.select(
        *by,
        "split",
        F.col("sensitivity").alias("tpr"),
        F.col("balanced_accuracy").alias("BAccuracy"),
        F.col("specificity").alias("tnr"),
    )
    long = wide.unpivot([*by, "split"], ["tpr", "BAccuracy", "tnr"], "metric", "value")
    return long.select(*by, F.concat_ws("_", "split", "metric").alias("variable"), "value")


def series_view(long: DataFrame, view: str) -> DataFrame:
    """The train + validate view or the train + test view of a series."""
    hidden = {"validate": "test", "test": "validate"}[view]
    return long.filter(~F.col("variable").contains(hidden))


def best_parameters(
    metrics: DataFrame,
    params: Sequence[str],
    min_sensitivity: float = 0.8,
    by: Sequence[str] = (),
) -> DataFrame:
    """Highest balanced accuracy among points with enough sensitivity; ties: smallest parameters.

    Empty when no point qualifies; one row per group with ``by``.
    """
    good = metrics.filter(F.col("sensitivity") > min_sensitivity)
    order = F.struct(F.col("balanced_accuracy"), *(-F.col(p).cast("double") for p in params))
    row = F.struct(*params, "sensitivity", "specificity", "balanced_accuracy")
    best = good.groupBy(*by).agg(F.max_by(row, order).alias("best"))
    return best.filter(F.col("best").isNotNull()).select(*by, "best.*")
