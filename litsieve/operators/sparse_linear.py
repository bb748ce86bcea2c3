"""Feature-selecting linear classifier with the SCAD penalty.

Local linear approximation (Zou & Li 2008): a few weighted-L1 fits, each an L1 fit on rescaled
columns. The loss is squared (on signs, one pass over the rows per fit for up to 4096 terms) or
logistic (tens of passes); Spark's linear SVM has no L1 penalty.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Interaction, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators.metrics import class_counts
from litsieve.session import compact

# The shape of the penalty and the candidate penalties.
SCAD_A = 3.7
LAMBDAS = (0.01, 0.02, 0.03, 0.04, 0.05, 0.1, 0.3, 0.5, 1.0)
SMALLEST_WEIGHT = 0.01  # keeps a column of zero penalty finite after rescaling


def scad_weight(beta: np.ndarray, lam: float) -> np.ndarray:
    """Derivative of the SCAD penalty divided by lambda: 1 for small, 0 for large coefficients."""
    size = np.abs(beta)
    tail = np.maximum(SCAD_A * lam - size, 0.0) / ((SCAD_A - 1.0) * lam)
    return np.where(size <= lam, 1.0, np.minimum(tail, 1.0))


def tfidf_vectors(tokens: DataFrame, terms: Sequence[str], idf: Sequence[float]) -> DataFrame:
    """Sparse ml vectors from (doc_id, flag, split, tokens), without leaving the JVM."""
    counted = CountVectorizerModel.from_vocabulary(
        list(terms), inputCol="tokens", outputCol="tf"
    ).transform(tokens)
    scaled = counted.withColumn("share", F.coalesce(F.try_divide(F.lit(1.0), F.size("tokens")), F.lit(0.0)))
    shared = Interaction(inputCols=["share", "tf"], outputCol="tf_share").transform(scaled)
    product = ElementwiseProduct(
        scalingVec=Vectors.dense(list(idf)), inputCol="tf_share", outputCol="raw"
    )
    return product.transform(shared).drop("tokens", "tf", "share", "tf_share")


def _linear(loss: str, features: str, lam: float, l1: float, max_iter: int):
    common = dict(
        featuresCol=features, weightCol="weight", regParam=lam, elasticNetParam=l1, standardization=False
    )
    if loss == "squared":
        return LinearRegression(labelCol="sign", solver="auto", **common)
    return LogisticRegression(labelCol="label", maxIter=max_iter, tol=1e-3, **common)


def scad_fit(rows: DataFrame, lam: float, steps: int = 3, max_iter: int = 200, loss: str = "squared"):
    """(column weights, last model) on (raw, label, sign, weight), starting from a ridge fit."""
    model = _linear(loss, "raw", lam, 0.0, max_iter).fit(rows)
    weight = np.ones(model.numFeatures)
    for _ in range(steps):
        beta = model.coefficients.toArray() / weight
        weight = np.maximum(scad_weight(beta, lam), SMALLEST_WEIGHT)
        model = _linear(loss, "features", lam, 1.0, max_iter).fit(_rescale(rows, weight, "features"))
    return weight, model


def _rescale(rows: DataFrame, weight: np.ndarray, output: str) -> DataFrame:
    inverse = Vectors.dense(1.0 / weight)
    return ElementwiseProduct(scalingVec=inverse, inputCol="raw", outputCol=output).transform(rows)


def scad_path(vectors: DataFrame, train: Column, lambdas: Sequence[float] = LAMBDAS, **options):
    """(fits, predictions): one fit per penalty, and the predictions of all in one pass."""
    scaler = StandardScaler(withMean=False, withStd=True, inputCol="raw", outputCol="scaled")
    fitted = scaler.fit(vectors.filter(train))
    scaled = fitted.transform(vectors).drop("raw").withColumnRenamed("scaled", "raw")
    labelled = scaled.filter(train)
    sizes = {r["flag"]: r["n"] for r in class_counts(labelled).collect()}
    smallest = min(sizes.values())
    cached = compact(labelled, sum(sizes.values())).select(
        "raw",
        F.col("flag").cast("double").alias("label"),
        (F.col("flag").cast("double") * 2 - 1).alias("sign"),
        F.when(F.col("flag"), smallest / sizes.get(True, 1))
        .otherwise(smallest / sizes.get(False, 1))
        .alias("weight"),
    ).persist()
    cached.count()
    with ThreadPool(min(8, len(lambdas))) as pool:
        fits = dict(zip(lambdas, pool.map(lambda lam: scad_fit(cached, lam, **options), lambdas)))
    cached.unpersist()
    return fits, _score(scaled, fits)


def _score(vectors: DataFrame, fits: dict) -> DataFrame:
    keep = [c for c in vectors.columns if c != "raw"]
    scored, outcome = vectors, []
    for i, (lam, (weight, model)) in enumerate(fits.items()):
        model.setFeaturesCol(f"f{i}").setPredictionCol(f"p{i}")
        logistic = isinstance(model, LogisticRegressionModel)
        if logistic:
            model.setRawPredictionCol("").setProbabilityCol("")
        positive = F.col(f"p{i}") == 1.0 if logistic else F.col(f"p{i}") >= 0
        scored = model.transform(_rescale(scored, weight, f"f{i}")).drop(f"f{i}")
        outcome.append(
            F.struct(
                F.lit(float(lam)).alias("lambda"),
                F.lit(model.coefficients.numNonzeros()).alias("n_selected"),
                positive.alias("predicted"),
            )
        )
    return scored.select(*keep, F.inline(F.array(*outcome)))


def selected_terms(terms: Sequence[str], weight: np.ndarray, model) -> list[tuple[str, float]]:
    """Terms with a non-zero coefficient, in units of one standard deviation."""
    beta = model.coefficients.toArray() / weight
    return [(t, float(b)) for t, b in zip(terms, beta) if b != 0.0]
