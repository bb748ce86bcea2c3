"""Class-weighted RBF SVM: random Fourier features (Rahimi & Recht 2007) and linear SVMs on them.

Spark has no kernel SVM; the feature map approximates the kernel and the linear fits scale with the rows. Single models, curves,
grids and tuning all use the same fits (``operators.hinge``): every combination of kernel width, cost and train rows is
fitted side by side on features that are computed and cached once.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.keys import FOLD_SEED
from litsieve.operators import hinge
from litsieve.operators.split import fold_column
from litsieve.session import ship_package

COMPONENTS = 256


@dataclass(frozen=True)
class Scaling:
    """Mean and standard deviation per term, from train rows; one entry per vocabulary term."""

    mean: np.ndarray
    sd: np.ndarray


def fit_scaling(vectors: DataFrame, n_features: int) -> Scaling:
    """Column statistics from sparse rows; absent terms count as zero."""
    n = vectors.count()
    entries = vectors.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).select("e.idx", "e.val")
    sums = entries.groupBy("idx").agg(F.sum("val").alias("s"), F.sum(F.col("val") ** 2).alias("ss"))
    mean, square = np.zeros(n_features), np.zeros(n_features)
    for row in sums.toLocalIterator():  # one row per vocabulary term
        mean[row["idx"]], square[row["idx"]] = row["s"] / max(n, 1), row["ss"]
    variance = (square - n * mean**2) / max(n - 1, 1)
    return Scaling(mean, np.sqrt(np.maximum(variance, 0.0)))


def random_weights(n_features: int, components: int, seed: int):
    """Directions of a kernel of width 1, and shifts."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n_features, components)), rng.uniform(0.0, 2.0 * np.pi, components)


def dense_rows(idx: pd.Series, val: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(idx), width))
    rows = np.repeat(np.arange(len(idx)), idx.str.len().to_numpy(dtype=np.int64))
    if len(rows):
        out[rows, np.concatenate(idx.to_list())] = np.concatenate(val.to_list())
    return out


class FourierMap:
    """Features of sparse rows for several kernel widths, from one projection.

    The random matrix is drawn again in each task from the seed instead of being shipped. Constant terms are dropped. Centring
    becomes a shift, so rows stay sparse.
    """

    def __init__(self, scaling: Scaling, gammas: Sequence[float], components: int = COMPONENTS, seed: int = 42) -> None:
        self.scaling, self.gammas, self.components, self.seed = scaling, tuple(gammas), components, seed
        self._drawn: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_drawn": None}

    def __call__(self, idx: pd.Series, val: pd.Series) -> list[np.ndarray]:
        if self._drawn is None:
            weights, shift = random_weights(len(self.scaling.mean), self.components, self.seed)
            used = self.scaling.sd > 0
            weights = weights * np.where(used, 1.0 / np.where(used, self.scaling.sd, 1.0), 0.0)[:, None]
            self._drawn = weights, self.scaling.mean @ weights, shift
        weights, centre, shift = self._drawn
        projected = dense_rows(idx, val, len(weights)) @ weights - centre
        factor = np.sqrt(2.0 / self.components)
        return [factor * np.cos(np.sqrt(2.0 * gamma) * projected + shift) for gamma in self.gammas]


def _report(fits: Sequence[hinge.Fit], states: Sequence[hinge.State | None]) -> None:
    """Says which fits have stopped before they met the tolerance."""
    left = [f"cost {f.cost:g}" for f, s in zip(fits, states, strict=True) if s is not None and not s.converged]
    if left:
        warnings.warn(f"{len(left)} of {len(fits)} SVM fits have not converged: {', '.join(left[:5])}", stacklevel=3)


def _scorer(project: FourierMap, weights: list[np.ndarray], spaces: list[int], chunk: int = 1024):
    """Column function (idx, val) -> whether each fit says TRUE."""

    @F.pandas_udf("array<boolean>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for idx, val in batches:
            out: list[np.ndarray] = []
            for start in range(0, len(idx), chunk):
                found = project(idx.iloc[start : start + chunk], val.iloc[start : start + chunk])
                margins = [found[k] @ w[:-1] + w[-1] for k, w in zip(spaces, weights, strict=True)]
                out.extend(np.stack(margins, axis=1) >= 0)
            yield pd.Series(out, dtype=object)

    return score


def svm_predictions(
    vectors: DataFrame,
    n_features: int,
    points: Sequence[Mapping[str, float]],
    train: Column | Sequence[Column],
    components: int = COMPONENTS,
    max_iter: int = 100,
    seed: int = 42,
) -> DataFrame:
    """``vectors`` columns + cost, gamma, predicted for each point of ``points``; with a list of train rows also ``subset``, its number.

    All fits share features that are scaled by the train rows of any subset. Where train rows lack a class nothing is fitted and
    the predictions are null. Fits that end without meeting the tolerance are reported as a warning.
    """
    ship_package()
    subsets = [train] if isinstance(train, Column) else list(train)
    marked = vectors.withColumn("member", hinge.member_bits(subsets))
    keep = [c for c in vectors.columns if c not in ("idx", "val")]
    gammas = sorted({float(p["gamma"]) for p in points})
    fits = [hinge.Fit(gammas.index(float(p["gamma"])), k, float(p["cost"])) for k in range(len(subsets)) for p in points]
    sizes = hinge.subset_sizes(marked, len(subsets))
    project = FourierMap(fit_scaling(marked.filter("member <> 0"), n_features), gammas, components, seed)
    blocks = hinge.feature_blocks(marked.filter("member <> 0"), project).persist()
    states = hinge.solve(blocks, fits, sizes, max_passes=max_iter)
    blocks.unpersist()
    _report(fits, states)
    live = [i for i, s in enumerate(states) if s is not None]
    told = _scorer(project, [states[i].w for i in live], [fits[i].space for i in live])("idx", "val") if live else None
    outcome = F.array(
        *(
            F.struct(
                F.lit(f.subset).alias("subset"),
                F.lit(f.cost).alias("cost"),
                F.lit(gammas[f.space]).alias("gamma"),
                (F.get("told", F.lit(live.index(i))) if i in live else F.lit(None).cast("boolean")).alias("predicted"),
            )
            for i, f in enumerate(fits)
        )
    )
    scored = vectors.withColumn("told", told) if live else vectors
    found = scored.select(*keep, F.inline(outcome))
    return found.drop("subset") if isinstance(train, Column) else found


def svm_tallies(
    parts: Sequence[tuple[DataFrame, int]],
    points: Sequence[Mapping[str, float]],
    subsets: Sequence[Column],
    components: int = COMPONENTS,
    seed: int = 42,
) -> list[dict]:
    """For each part (vectors, n_features), point and subset of train rows: tp, fp, fn, tn on the part's other rows.

    Everything is fitted in one go: features of all parts and kernel widths are cached together.
    """
    gammas = sorted({float(p["gamma"]) for p in points})
    fits, keys, blocks, sizes = [], [], None, []
    for number, (vectors, n_features) in enumerate(parts):
        marked = vectors.withColumn("member", hinge.member_bits(subsets))
        sizes.append(hinge.subset_sizes(marked, len(subsets)))
        own = hinge.feature_blocks(marked, FourierMap(fit_scaling(vectors, n_features), gammas, components, seed), number * len(gammas))
        blocks = own if blocks is None else blocks.unionByName(own)
        for k in range(len(subsets)):
            for p in points:
                fits.append(hinge.Fit(number * len(gammas) + gammas.index(float(p["gamma"])), number * len(subsets) + k, float(p["cost"])))
                keys.append({"part": number, "subset": k, "cost": float(p["cost"]), "gamma": float(p["gamma"])})
    # the subsets are the same bits in every part, whose rows have spaces of their own
    sized = np.concatenate(sizes)
    blocks = blocks.persist()
    states = hinge.solve(blocks, fits, sized, bits=len(subsets))
    found = hinge.tallies(blocks, fits, states, bits=len(subsets))
    blocks.unpersist()
    _report(fits, states)
    return [key | dict(zip(("tp", "fp", "fn", "tn"), map(int, row), strict=True)) for key, row in zip(keys, found, strict=True)]


def svm_grid(
    vectors: DataFrame,
    n_features: int,
    gammas: Sequence[float] = (0.5, 1.0, 2.0),
    costs: Sequence[float] = (2.0, 4.0, 8.0, 16.0),
    folds: int = 10,
    components: int = COMPONENTS,
    seed: int = 42,
) -> DataFrame:
    """Cross-validated error per (gamma, cost): one row per grid point."""
    points = [{"cost": c, "gamma": g} for g in gammas for c in costs]
    fold = fold_column(folds, FOLD_SEED)
    cells = svm_tallies([(vectors, n_features)], points, [fold != f for f in range(folds)], components, seed)
    result = []
    for g in gammas:
        for c in costs:
            own = [x for x in cells if x["gamma"] == g and x["cost"] == c]
            shares = [(x["fp"] + x["fn"]) / n for x in own if (n := x["tp"] + x["fp"] + x["fn"] + x["tn"])]
            result.append((float(g), float(c), float(np.mean(shares)) if shares else None, float(np.std(shares)) if shares else None))
    return vectors.sparkSession.createDataFrame(result, "gamma double, cost double, error double, dispersion double")
