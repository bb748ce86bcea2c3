"""Quality classifier: a sparse ensemble of rules.

Shallow trees are fitted to statistics of labelled texts. Every path from a root is a rule, a conjunction of
comparisons; a logistic regression with an L1 penalty weighs the rules and sets most to zero. What is left is
compiled into one Spark column expression over the statistics: scoring runs no model code and no Python.

The statistics of all rows are computed in one pass over the whole texts. The fit uses labelled rows
only, about ``max_train`` of them at most: rows whose id hashes below max_train / labelled rows. The bound
keeps the fit's cost apart from the size of the corpus.

Null and empty texts have statistics of 0 and get a score like any other. Without labels of both kinds
every score is the share of label 1 among the labels, or 1.0 without any. Null labels are not
used. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.session import materialize

#: Rows of the fit at most, about.
MAX_TRAIN = 20_000
#: Files of the rows of the fit.
TRAIN_FILES = 4


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, as columns. Shares are of characters, words or lines."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, "[ \t\n\x0b\x0c\r]+"), lambda w: w != "")
    lines = F.split(text, "\n")

    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / chars

    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.size(lines).cast("double")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "chars_per_word": chars / n_words,
        "chars_per_line": F.log1p(chars / n_lines),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "stops": share(".,;:?"),
        "calls": share("!"),
        "bars": share("|"),
        "marks": share("#$%&*+=<>@^_`~\\/{}[]"),
        "digits": share("0123456789"),
        "spaces": share(" \t\n\x0b\x0c\r"),
        "capitals": F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")) / chars,
        "ascii": share("abcdefghijklmnopqrstuvwxyz"),
    }


#: The statistics in the order of the trees' features.
NAMES = (
    "log_chars", "chars_per_word", "chars_per_line", "distinct_words", "distinct_lines", "stops", "calls", "bars",
    "marks", "digits", "spaces", "capitals", "ascii",
)

#: (statistic, whether it is above, threshold)
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, columns: dict[str, Column] | None = None) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(conditions: tuple[Condition, ...], columns: dict[str, Column] | None = None) -> Column:
    found = F.lit(True)
    for name, above, threshold in conditions:
        column = columns[name] if columns else F.col(name)
        found = found & (column > threshold if above else column <= threshold)
    return found


_BRANCH = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)")


def tree_rules(description: str) -> list[tuple[Condition, ...]]:
    """All paths of a tree from its printed form; a path keeps the tightest bound of a statistic."""
    path: list[Condition] = []
    indents: list[int] = []
    found = []
    for line in description.split("\n"):
        if not (m := _BRANCH.match(line)):
            continue
        while indents and indents[-1] >= len(m[1]):
            indents.pop()
            path.pop()
        indents.append(len(m[1]))
        path.append((NAMES[int(m[3])], m[4] == ">", float(m[5])))
        tight: dict[tuple[str, bool], float] = {}
        for name, above, threshold in path:
            known = tight.get((name, above))
            tight[name, above] = threshold if known is None else max(known, threshold) if above else min(known, threshold)
        found.append(tuple(sorted((name, above, t) for (name, above), t in tight.items())))
    return found


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """From rows of the statistics and ``label`` (0 or 1)."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel(40.0 if counts.get(1, 0) or not counts else -40.0)
    assembler = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    rows = assembler.transform(labelled.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.6", minInfoGain=1e-4, maxBins=64
    ).fit(rows)
    # equal paths of several trees are one rule
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString)})
    if not rules:
        good = counts.get(1, 0) / sum(counts.values())
        return RuleModel(math.log(good / (1 - good)))
    flags = [holds(rule).cast("double").alias(f"r{i}") for i, rule in enumerate(rules)]
    binary = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features")
    inputs = materialize(binary.transform(labelled.select(F.col("label").cast("double").alias("label"), *flags)).select("label", "features"), "rules")
    line = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=200, tol=1e-6).fit(inputs)
    weights = line.coefficients.toArray()
    return RuleModel(float(line.intercept), [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w])


def train_rows(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str, max_train: int) -> DataFrame:
    """Labelled statistics; a row of ``stats`` counts once for each label of its id."""
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1)")
    joined = materialize(stats.join(marks, F.col("id") == F.col("label_id")).select("id", *NAMES, "label"), "labelled")
    share = min(1.0, max_train / max(1, joined.count()))
    chosen = joined.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # bounded by max_train, so few files: every step of the fit is a job over them
    return materialize(chosen.coalesce(TRAIN_FILES), "train")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every row."""
    found = statistics(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("id"), *(c.cast("double").alias(n) for n, c in found.items()))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, max_train: int = MAX_TRAIN,
) -> DataFrame:
    """(id, score, predicted) of every row, by the rules learnt from all of ``labels``."""
    stats = materialize(text_statistics(docs, id_col, text_col), "statistics")
    model = fit(train_rows(stats, labels, label_col, id_col, max_train))
    scored = stats.select(F.col("id").alias(id_col), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
