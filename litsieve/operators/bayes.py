"""Naive Bayes on present / absent terms, as two aggregations and one join.

Many models (sparse levels, learning-curve prefixes, folds) are fitted and applied together:
each is one more column of the same aggregations, so a sweep reads the data as often as a
single model does.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators.terms import dense_enough, tally
from litsieve.session import materialize, small_side

# A probability of at most EPS is replaced by THRESHOLD when scoring.
THRESHOLD = 0.001
EPS = 0.0


@dataclass(frozen=True)
class Variant:
    """One model: its parameters, the rows it learns from and its sparse level."""

    params: Mapping[str, object]
    train: str
    level: float
    scored: Column = field(default_factory=lambda: F.lit(True))


def _log_probability(count: Column, total: int) -> Column:
    p = count.cast("double") / F.lit(float(total))
    return F.ln(F.when(p <= EPS, THRESHOLD).otherwise(p))


def naive_bayes(
    docs: DataFrame,
    counts: DataFrame,
    trains: Mapping[str, Column],
    variants: Sequence[Variant],
    fit_scope: str = "all",
    weight: str | None = None,
) -> DataFrame:
    """Scores of every document under every variant that covers it.

    ``docs`` (doc_id, flag, ...) holds all documents, also those without terms; ``counts`` is a
    term table whose kept columns serve the ``trains`` conditions. ``fit_scope='all'`` takes
    document frequencies from all rows, ``'train'`` from each model's own train rows. ``weight`` names a
    column of both tables: a row then counts as that many equal rows.
    Returns docs columns, the parameters, score_true, score_false, predicted.
    """
    flag = F.col("flag")
    names = list(trains)
    sizes = docs.agg(
        tally(F.lit(True), weight).alias("n"),
        *(tally(trains[t] & flag, weight).alias(f"{t}_true") for t in names),
        *(tally(trains[t] & ~flag, weight).alias(f"{t}_false") for t in names),
    ).first()

    frequencies = counts.groupBy("term").agg(
        tally(F.lit(True), weight).alias("df"),
        *(tally(trains[t] & flag, weight).alias(f"{t}_true") for t in names),
        *(tally(trains[t] & ~flag, weight).alias(f"{t}_false") for t in names),
    )
    columns, used = [], F.lit(False)
    for i, v in enumerate(variants):
        if fit_scope == "all":
            df, n = F.col("df"), sizes["n"]
        else:
            df = F.col(f"{v.train}_true") + F.col(f"{v.train}_false")
            n = sizes[f"{v.train}_true"] + sizes[f"{v.train}_false"]
        # a term of every document has weight 0: absent everywhere, the same for both classes
        inside = dense_enough(df, n, v.level) & (df < n)
        used = used | inside
        for side in ("true", "false"):
            total = sizes[f"{v.train}_{side}"]
            seen = F.col(f"{v.train}_{side}")
            if total == 0:
                columns += [F.lit(0.0).alias(f"p{i}_{side}"), F.lit(0.0).alias(f"b{i}_{side}")]
                continue
            absent = _log_probability(F.lit(total) - seen, total)
            gain = _log_probability(seen, total) - absent
            columns.append(F.when(inside, gain).otherwise(0.0).alias(f"p{i}_{side}"))
            columns.append(F.when(inside, absent).otherwise(0.0).alias(f"b{i}_{side}"))
    model = materialize(frequencies.filter(used).select("term", *columns), "nb-model")

    keys = [f"{i}_{side}" for i in range(len(variants)) for side in ("true", "false")]
    base = model.agg(*(F.sum(f"b{k}").alias(k) for k in keys)).first()
    gains = small_side(model.select("term", *(f"p{k}" for k in keys)))
    per_doc = (
        counts.select("doc_id", "term")
        .join(gains, "term")
        .groupBy("doc_id")
        .agg(*(F.sum(f"p{k}").alias(f"s{k}") for k in keys))
    )
    rows = []
    for i, v in enumerate(variants):
        n = {side: sizes[f"{v.train}_{side}"] for side in ("true", "false")}
        score = {}
        for side in ("true", "false"):
            if n[side] == 0:
                score[side] = F.lit(None).cast("double")
            else:
                start = math.log(n[side] / sum(n.values())) + (base[f"{i}_{side}"] or 0.0)
                score[side] = F.lit(start) + F.coalesce(F.col(f"s{i}_{side}"), F.lit(0.0))
        if 0 in n.values():  # one class only: predict it; no train row at all: no prediction
            predicted = F.lit(None if n["true"] == n["false"] else n["false"] == 0).cast("boolean")
        else:
            predicted = F.round(score["true"] - score["false"], 9) >= 0
        rows.append(
            F.struct(
                *(F.lit(value).alias(name) for name, value in v.params.items()),
                score["true"].alias("score_true"),
                score["false"].alias("score_false"),
                predicted.alias("predicted"),
                v.scored.alias("_scored"),
            )
        )
    scored = docs.join(per_doc, "doc_id", "left").select(*docs.columns, F.inline(F.array(*rows)))
    return scored.filter("_scored").drop("_scored")
