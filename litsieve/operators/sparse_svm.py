"""Feature-selecting linear SVM: the bent hinge of ``operators.hinge`` with the SCAD penalty, for a path of penalties.

Rows become blocks of sparse features divided by their standard deviation on the train rows, cached for all passes. One pass sums
loss and gradient of every penalty, restricted to the union of their working columns; the driver moves all fits in step by
proximal gradient steps with a step length from the last two gradients and a search that looks back a few steps (Gong et al.
2013). Columns are centred on the driver: means shift the intercept and the gradient, so rows stay sparse. When the fits
stand still, a pass over all columns adds those whose gradient exceeds the penalty; the path ends when none does. So tasks
return one short vector a fit, and a block is spread out over the working columns alone.

The objective of a fit is the mean loss, weighted by class, plus the penalty of each coefficient; the intercept is free.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators import hinge
from litsieve.operators.metrics import confusion_metrics
from litsieve.operators.sparse_linear import LAMBDAS, SCAD_A
from litsieve.operators.svm import Scaling, fit_scaling
from litsieve.session import ship_package

TOLERANCE = 1e-2  # of the penalty: what a coefficient's gradient may be off
BLOCK_ROWS = 1024
_BLOCKS = "idx binary, val binary, ends binary, sign binary, member binary"
_TRAIN, _VALIDATE = 1, 2
_SEARCH = 1e-5  # least decrease, as a share of the squared step
_LOOK_BACK = 5
_STILL = 6  # passes in which the objective must fall by more than STILL_SHARE of itself
STILL_SHARE = 1e-2


def scad_penalty(beta: np.ndarray, lam: float) -> np.ndarray:
    size = np.abs(beta)
    middle = (2 * SCAD_A * lam * size - size**2 - lam**2) / (2 * (SCAD_A - 1))
    return np.where(size <= lam, lam * size, np.where(size <= SCAD_A * lam, middle, lam**2 * (SCAD_A + 1) / 2))


def scad_threshold(z: np.ndarray, lam: float, step: float) -> np.ndarray:
    """The b with the least (b - z)^2 / (2 step) + penalty; unique for a step below a - 1."""
    size = np.abs(z)
    soft = np.maximum(size - step * lam, 0.0)
    middle = ((SCAD_A - 1) * size - SCAD_A * step * lam) / (SCAD_A - 1 - step)
    return np.sign(z) * np.where(size <= lam * (1 + step), soft, np.where(size <= SCAD_A * lam, middle, size))


@dataclass
class SparseFit:
    """One penalty. ``beta`` is in units of a standard deviation of the centred column, with the intercept last."""

    lam: float
    beta: np.ndarray
    values: list[float] = field(default_factory=list)
    gradient: np.ndarray | None = None
    trial: np.ndarray | None = None
    curvature: float = 1.0
    converged: bool = False
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def balanced_accuracy(self) -> float | None:
        """On the validation rows; None where they lack a class."""
        c = self.counts
        positive, negative = c["tp"] + c["fn"], c["tn"] + c["fp"]
        return (c["tp"] / positive + c["tn"] / negative) / 2 if positive and negative else None


@dataclass
class SparsePath:
    fits: list[SparseFit]
    chosen: int | None  # the most accurate on the validation rows, of equal ones the one with the fewest terms
    scaling: Scaling

    def weights(self, k: int) -> np.ndarray:
        """Coefficients for columns as they are, with the intercept last."""
        beta, sd = self.fits[k].beta, self.scaling.sd
        found = np.where(sd > 0, beta[:-1] / np.where(sd > 0, sd, 1.0), 0.0)
        return np.append(found, beta[-1] - self.scaling.mean @ found)


def _sparse_blocks(rows: DataFrame, sd: np.ndarray) -> DataFrame:
    """Blocks of (idx, val, flag, member); constant columns are left out."""
    ship_package()
    inverse = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[start : start + BLOCK_ROWS]
                idx = np.concatenate([np.zeros(0, np.int32), *part["idx"]]).astype(np.int32)
                val = np.concatenate([np.zeros(0), *part["val"]]) * inverse[idx]
                yield pd.DataFrame(
                    {
                        "idx": [idx.tobytes()], "val": [val.tobytes()], "ends": [np.cumsum(part["idx"].str.len()).to_numpy(np.int64).tobytes()],
                        "sign": [np.where(part["flag"].to_numpy(bool), 1, -1).astype(np.int8).tobytes()],
                        "member": [part["member"].to_numpy(np.int8).tobytes()],
                    }
                )

    return rows.select("idx", "val", "flag", "member").mapInPandas(run, _BLOCKS)


def _dense_blocks(batches, columns: np.ndarray, width: int, member: int, cells: int = 4 << 20):
    """(features of ``columns`` and a column of ones, signs) of the rows of a member, some rows at a time."""
    place = np.full(width, -1)
    place[columns] = np.arange(len(columns))
    at_once = max(1, cells // (len(columns) + 1))
    for batch in batches:
        for idx, val, ends, sign, own in zip(*(batch.column(k) for k in range(5)), strict=True):
            idx, val = np.frombuffer(idx.as_buffer(), np.int32), np.frombuffer(val.as_buffer(), float)
            ends, sign = np.frombuffer(ends.as_buffer(), np.int64), np.frombuffer(sign.as_buffer(), np.int8).astype(float)
            inside = np.frombuffer(own.as_buffer(), np.int8) == member
            row, at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), place[idx]
            for start in range(0, len(ends), at_once):
                stop = min(start + at_once, len(ends))
                x = np.zeros((stop - start, len(columns) + 1))
                x[:, -1] = 1.0
                used = (at >= 0) & (row >= start) & (row < stop)
                x[row[used] - start, at[used]] = val[used]
                yield x[inside[start:stop]], sign[start:stop][inside[start:stop]]


def _uncentred(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The same planes for columns that are not centred."""
    return np.vstack([points[:-1], points[-1] - means @ points[:-1]])


def _objectives(blocks: DataFrame, points: np.ndarray, columns: np.ndarray, weights: tuple[float, float], means: np.ndarray) -> np.ndarray:
    """(1 + columns + 1, fits): mean loss of each point and its gradient in ``columns`` and the intercept.

    Points (width + 1, fits) are zero outside of ``columns``; ``means`` are those of the scaled columns.
    """
    width, own = len(points) - 1, _uncentred(points, means)[np.append(columns, len(points) - 1)]

    def run(batches):
        sums = np.zeros((len(own) + 1, own.shape[1]))
        for x, sign in _dense_blocks(batches, columns, width, _TRAIN):
            loss, slope = hinge.bent_hinge(sign[:, None] * (x @ own))
            weight = np.where(sign > 0, weights[1], weights[0])[:, None]
            sums += np.vstack([(weight * loss).sum(axis=0), x.T @ (weight * slope * sign[:, None])])
        yield hinge._rows({k: sums[:, k].copy() for k in range(own.shape[1])})

    found = hinge._summed(blocks, run, own.shape[1])
    sums = np.stack([found[k] for k in range(own.shape[1])], axis=1)
    sums[1:-1] -= means[columns][:, None] * sums[-1]
    return sums


def _propose(fit: SparseFit, columns: np.ndarray) -> None:
    """The next trial point, which differs in ``columns`` and the intercept.

    The fit has converged when it meets the tolerance, or when its objective hardly falls any more: where the selected terms separate
    the classes, the penalty of large coefficients is flat and the gradient falls slowly.
    """
    step, places = 1.0 / fit.curvature, np.append(columns, len(fit.beta) - 1)
    z = fit.beta[places] - step * fit.gradient
    fit.trial = fit.beta.copy()
    fit.trial[places] = np.append(scad_threshold(z[:-1], fit.lam, step), z[-1])
    still = len(fit.values) > _STILL and min(fit.values[:-_STILL]) - min(fit.values) <= STILL_SHARE * min(fit.values)
    fit.converged = bool(still or np.abs(fit.trial - fit.beta).max() * fit.curvature <= TOLERANCE * fit.lam)


def _accept(fit: SparseFit, loss: float, gradient: np.ndarray, columns: np.ndarray) -> None:
    places = np.append(columns, len(fit.beta) - 1)
    value = loss + scad_penalty(fit.trial[:-1], fit.lam).sum()
    move = (fit.trial - fit.beta)[places]
    if value > max(fit.values[-_LOOK_BACK:]) - _SEARCH * fit.curvature * (move @ move) and fit.curvature < 1e8:
        fit.curvature *= 2.0
    else:
        if move @ move > 0:
            # a step of at most 1 stays well below a - 1
            fit.curvature = float(np.clip((move @ (gradient - fit.gradient)) / (move @ move), 1.0, 1e6))
        fit.beta, fit.gradient = fit.trial, gradient
        fit.values.append(value)
    _propose(fit, columns)


def _solve(blocks: DataFrame, fits: list[SparseFit], weights: tuple[float, float], means: np.ndarray, max_passes: int) -> None:
    width = len(fits[0].beta) - 1
    columns, passes = np.zeros(0, int), 0
    while passes < max_passes:
        everything = np.arange(width)
        found = _objectives(blocks, np.stack([f.beta for f in fits], axis=1), everything, weights, means)
        passes += 1
        off = [(f.beta[:-1] == 0) & (np.abs(found[1:-1, k]) > f.lam * (1 + TOLERANCE)) for k, f in enumerate(fits)]
        used = np.any([f.beta[:-1] != 0 for f in fits], axis=0) | np.any(off, axis=0)
        grown = np.union1d(columns, np.flatnonzero(used))
        if passes > 1 and len(grown) == len(columns) and all(f.converged for f in fits):
            return
        columns = grown
        for k, f in enumerate(fits):
            f.values = [found[0, k] + scad_penalty(f.beta[:-1], f.lam).sum()]
            f.gradient = found[1:, k][np.append(columns, width)]
            _propose(f, columns)
        while passes < max_passes and (active := [f for f in fits if not f.converged]):
            found = _objectives(blocks, np.stack([f.trial for f in active], axis=1), columns, weights, means)
            passes += 1
            for k, f in enumerate(active):
                _accept(f, found[0, k], found[1:, k], columns)


def _count(blocks: DataFrame, fits: list[SparseFit], means: np.ndarray) -> None:
    points = _uncentred(np.stack([f.beta for f in fits], axis=1), means)
    columns = np.flatnonzero(np.any(points[:-1] != 0, axis=1))
    own = points[np.append(columns, len(points) - 1)]

    def run(batches):
        sums = np.zeros((4, own.shape[1]))
        for x, sign in _dense_blocks(batches, columns, len(points) - 1, _VALIDATE):
            positive, true = x @ own >= 0, sign[:, None] > 0
            sums += [c.sum(axis=0) for c in (positive & true, positive & ~true, ~positive & true, ~positive & ~true)]
        yield hinge._rows({k: sums[:, k].copy() for k in range(own.shape[1])})

    for k, values in hinge._summed(blocks, run, len(fits)).items():
        fits[k].counts = dict(zip(("tp", "fp", "fn", "tn"), map(int, values.round()), strict=True))


def sparse_svm_path(
    vectors: DataFrame, n_features: int, train: Column, validate: Column, lambdas: Sequence[float] = LAMBDAS, max_passes: int = 200
) -> SparsePath | None:
    """One fit per penalty, and the one with the best balanced accuracy on the validation rows.

    ``vectors`` has (idx, val, flag). Null where the train rows lack a class. Nothing is chosen where the validation rows lack one.
    Fits that have not met the tolerance after ``max_passes`` passes are reported as a warning.
    """
    marked = vectors.withColumn("member", F.when(train, _TRAIN).when(validate, _VALIDATE).otherwise(0).cast("byte")).filter("member <> 0")
    own = marked.filter(F.col("member") == _TRAIN)
    sizes = {r["flag"]: r["n"] for r in own.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    if not positive or not negative:
        return None
    scaling = fit_scaling(own, n_features)
    sd = scaling.sd
    means = np.where(sd > 0, scaling.mean / np.where(sd > 0, sd, 1.0), 0.0)
    blocks = _sparse_blocks(marked, sd).persist()
    fits = [SparseFit(float(lam), np.zeros(n_features + 1)) for lam in lambdas]
    # both classes weigh one half
    _solve(blocks, fits, (0.5 / negative, 0.5 / positive), means, max_passes)
    _count(blocks, fits, means)
    blocks.unpersist()
    if left := [f"{f.lam:g}" for f in fits if not f.converged]:
        warnings.warn(f"sparse SVMs have not converged for lambda {', '.join(left)}", stacklevel=2)
    known = [k for k, f in enumerate(fits) if f.balanced_accuracy is not None]
    chosen = max(known, key=lambda k: (fits[k].balanced_accuracy, -np.count_nonzero(fits[k].beta[:-1]), fits[k].lam), default=None)
    return SparsePath(fits, chosen, scaling)


def path_terms(vocab: DataFrame, path: SparsePath | None) -> DataFrame:
    """(lambda, term, weight, n_selected, chosen): the terms with a coefficient, in units of one standard deviation.

    ``vocab`` has (term, idx). What is joined has at most a row per penalty and term of the bounded vocabulary.
    """
    rows = [
        (fit.lam, int(j), float(fit.beta[j]), int(np.count_nonzero(fit.beta[:-1])), k == path.chosen)
        for k, fit in enumerate(path.fits if path else []) for j in np.flatnonzero(fit.beta[:-1])
    ]
    found = vocab.sparkSession.createDataFrame(rows, "lambda double, at int, weight double, n_selected long, chosen boolean")
    return found.join(vocab.select("idx", "term"), F.col("at") == F.col("idx")).select("lambda", "term", "weight", "n_selected", "chosen")


def path_summary(vocab: DataFrame, path: SparsePath | None) -> DataFrame:
    """A row per penalty: number of terms, confusion metrics of the validation rows, converged, chosen."""
    rows = [
        (fit.lam, int(np.count_nonzero(fit.beta[:-1])), *(fit.counts[c] for c in ("tp", "fp", "fn", "tn")), fit.converged, k == path.chosen)
        for k, fit in enumerate(path.fits if path else [])
    ]
    table = vocab.sparkSession.createDataFrame(rows, "lambda double, n_selected long, tp long, fp long, fn long, tn long, converged boolean, chosen boolean")
    return confusion_metrics(table)


def predict(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """``vectors`` with ``predicted``; columns without a coefficient are not read. ``weights`` as of ``SparsePath.weights``."""
    used = {int(j): float(weights[j]) for j in np.flatnonzero(weights[:-1])}
    entries = [x for j, w in used.items() for x in (F.lit(j), F.lit(w))]
    coefficient = F.create_map(*entries) if entries else F.create_map().cast("map<int,double>")
    parts = F.zip_with("idx", "val", lambda j, x: x * F.coalesce(F.try_element_at(coefficient, j), F.lit(0.0)))
    margin = F.aggregate(parts, F.lit(float(weights[-1])), lambda a, b: a + b)
    return vectors.withColumn("predicted", margin >= 0)
