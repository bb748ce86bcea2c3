import numpy as np
import pytest
from pyspark.sql import functions as F

from litsieve.operators import hinge, sparse_svm
from litsieve.operators.sparse_linear import SCAD_A


def penalty_by_integration(size, lam):
    grid = np.linspace(0.0, size, 20001)
    slope = np.where(grid <= lam, lam, np.maximum(SCAD_A * lam - grid, 0.0) / (SCAD_A - 1))
    return float(((slope[1:] + slope[:-1]) / 2 * np.diff(grid)).sum())


@pytest.mark.parametrize("size", [0.0, 0.1, 0.3, 0.7, 2.0])
def test_penalty_is_the_integral_of_its_slope(size):
    assert sparse_svm.scad_penalty(np.array([-size]), 0.25)[0] == pytest.approx(penalty_by_integration(size, 0.25), abs=1e-5)


@pytest.mark.parametrize("step", [0.3, 1.0])
def test_threshold_is_the_least_point_of_a_grid(step):
    grid = np.linspace(-3, 3, 60001)
    for z in (-2.5, -0.9, -0.4, 0.0, 0.2, 0.55, 0.8, 1.1, 2.0):
        best = grid[np.argmin((grid - z) ** 2 / (2 * step) + sparse_svm.scad_penalty(grid, 0.25))]
        assert sparse_svm.scad_threshold(np.array([z]), 0.25, step)[0] == pytest.approx(best, abs=1e-3)


def table(spark, n=400, width=8, seed=3):
    """Labels follow columns 0 and 1 with noise; column 7 is constant."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.5, rng.random((n, width)), 0.0)
    x[:, 7] = 1.0
    flag = x[:, 0] - x[:, 1] + 0.25 * rng.standard_normal(n) > 0
    part = np.where(np.arange(n) % 4 < 3, "train", "validate")
    rows = [
        (int(i), bool(flag[i]), str(part[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(n)
    ]
    return spark.createDataFrame(rows, "doc_id long, flag boolean, split string, idx array<int>, val array<double>").repartition(2), x, flag, part


def plain_path(x, sign, lam, steps=20000):
    """Proximal steps of fixed length on centred, scaled rows, all in one place."""
    sd = x.std(axis=0, ddof=1)
    scaled = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0), 0.0)
    weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())
    beta, b, step = np.zeros(x.shape[1]), 0.0, 0.2
    for _ in range(steps):
        slope = weight * hinge.bent_hinge(sign * (scaled @ beta + b))[1] * sign
        beta = sparse_svm.scad_threshold(beta - step * (scaled.T @ slope), lam, step)
        b -= step * slope.sum()
    return beta, (weight * hinge.bent_hinge(sign * (scaled @ beta + b))[0]).sum() + sparse_svm.scad_penalty(beta, lam).sum()


def test_path_against_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(sparse_svm, "STILL_SHARE", 0.0)
    frame, x, flag, part = table(spark)
    is_train, is_validate = F.col("split") == "train", F.col("split") == "validate"
    path = sparse_svm.sparse_svm_path(frame, 8, is_train, is_validate, lambdas=(0.05, 0.1, 0.3, 2.0))
    own, sign = x[part == "train"], np.where(flag[part == "train"], 1.0, -1.0)
    for fit in path.fits:
        assert fit.converged and fit.beta[7] == 0
        beta, value = plain_path(own, sign, fit.lam)
        assert fit.values[-1] == pytest.approx(value, rel=0.01)
        assert set(np.flatnonzero(fit.beta[:-1])) == set(np.flatnonzero(beta))
    assert not path.fits[-1].beta[:-1].any()
    assert set(np.flatnonzero(path.fits[2].beta[:-1])) <= {0, 1} and path.chosen != 3
    # counts and predictions with the weights of columns as they are
    for k, fit in enumerate(path.fits):
        w = path.weights(k)
        told = x @ w[:-1] + w[-1] >= 0
        if fit.beta[:-1].any():
            assert {r["doc_id"]: r["predicted"] for r in sparse_svm.predict(frame, w).collect()} == dict(enumerate(told.tolist()))
            seen = part == "validate"
            assert fit.counts == {
                "tp": int((told & flag & seen).sum()), "fp": int((told & ~flag & seen).sum()),
                "fn": int((~told & flag & seen).sum()), "tn": int((~told & ~flag & seen).sum()),
            }
    vocab = spark.createDataFrame([(f"t{j}", j) for j in range(8)], "term string, idx int")
    terms = sparse_svm.path_terms(vocab, path).collect()
    assert {r["term"] for r in terms if r["chosen"]} == {f"t{j}" for j in np.flatnonzero(path.fits[path.chosen].beta[:-1])}
    summary = {r["lambda"]: r for r in sparse_svm.path_summary(vocab, path).collect()}
    assert summary[2.0]["n_selected"] == 0 and [k for k, r in summary.items() if r["chosen"]] == [path.fits[path.chosen].lam]


def test_one_class_and_empty_tables(spark):
    frame, *_ = table(spark, 40)
    vocab = spark.createDataFrame([("t0", 0)], "term string, idx int")
    for rows in (frame.filter("flag"), frame.limit(0)):
        path = sparse_svm.sparse_svm_path(rows, 8, F.col("split") == "train", F.col("split") == "validate")
        assert path is None
        assert sparse_svm.path_terms(vocab, path).count() == 0 and sparse_svm.path_summary(vocab, path).count() == 0
    alone = sparse_svm.sparse_svm_path(frame, 8, F.lit(True), F.lit(False), lambdas=(0.1,))
    assert alone.chosen is None and alone.fits[0].balanced_accuracy is None
