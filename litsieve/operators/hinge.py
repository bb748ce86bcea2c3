"""Many class-weighted linear SVMs on shared features, fitted side by side.

Rows become blocks of features, one block for each feature space (a kernel width, say), cached for all passes. One pass gives loss and
gradient of every fit (space, train rows, cost): the margins of a space's fits are one matrix product, their gradients another. Sums
are added up by fit in a second, small stage, so the driver sees one vector a fit. It keeps an L-BFGS state for each fit and moves
all of them in step, so a grid costs as many passes as its slowest fit. The Gram matrix of a space, from one pass more,
gives all of them a first guess of the curvature.

The loss is the hinge with a quadratic bend of half-width ``BEND`` about the margin (Chapelle 2007); intercepts are not penalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.session import ship_package

BEND = 0.5
TOLERANCE = 1e-4  # of the decrease that a step still promises, as a share of the objective
BLOCK_ROWS = 1024
_MEMORY = 8
_BLOCKS = "space int, x binary, sign binary, member binary"


@dataclass(frozen=True)
class Fit:
    """``subset`` numbers the train rows; modulo the number of bits in use it is a bit of the blocks' ``member``."""

    space: int
    subset: int
    cost: float


@dataclass
class State:
    """Where one fit stands."""

    w: np.ndarray
    weights: tuple[float, float]  # of a negative and of a positive row, times the cost
    value: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: float = 1.0
    history: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: int = 0
    done: bool = False
    converged: bool = False


def bent_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, derivative)."""
    gap = np.clip(1.0 + BEND - margin, 0.0, 2.0 * BEND)
    straight = np.maximum(1.0 - BEND - margin, 0.0)
    return gap * gap / (4.0 * BEND) + straight, -gap / (2.0 * BEND)


def member_bits(subsets: Sequence[Column]) -> Column:
    """A bit for each subset (63 at most) that holds the row."""
    bits = F.lit(0).cast("long")
    for k, inside in enumerate(subsets):
        bits = bits + F.when(inside, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def subset_sizes(vectors: DataFrame, n: int) -> np.ndarray:
    """(subsets, 2): rows of each class, from the ``member`` column."""
    inside = [(F.shiftright("member", k).bitwiseAND(1) == 1) for k in range(n)]
    counts = vectors.agg(*(F.count_if(i & (F.col("flag") == F.lit(c))).alias(f"n{k}_{c}") for k, i in enumerate(inside) for c in (False, True)))
    return np.array(counts.first(), float).reshape(n, 2)


def feature_blocks(vectors: DataFrame, project: Callable[[pd.Series, pd.Series], list[np.ndarray]], first_space: int = 0) -> DataFrame:
    """Blocks of (idx, val, flag, member); ``project`` gives the features of a chunk of rows in every space."""
    ship_package()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[start : start + BLOCK_ROWS]
                sign = np.where(part["flag"].to_numpy(bool), 1, -1).astype(np.int8).tobytes()
                member = part["member"].to_numpy(np.int64).tobytes()
                found = [np.ascontiguousarray(x, np.float32).tobytes() for x in project(part["idx"], part["val"])]
                yield pd.DataFrame(
                    {"space": range(first_space, first_space + len(found)), "x": found, "sign": [sign] * len(found), "member": [member] * len(found)}
                )

    return vectors.select("idx", "val", "flag", "member").mapInPandas(run, _BLOCKS)


def _blocks(batches, spaces) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(space, features with a column of ones, signs, members)."""
    for batch in batches:
        for space, x, sign, member in zip(*(batch.column(k) for k in range(4)), strict=True):
            if (space := space.as_py()) in spaces:
                sign = np.frombuffer(sign.as_buffer(), np.int8).astype(float)
                x = np.frombuffer(x.as_buffer(), np.float32).reshape(len(sign), -1)
                yield space, np.hstack([x, np.ones((len(sign), 1), np.float32)]), sign, np.frombuffer(member.as_buffer(), np.int64)


def _summed(blocks: DataFrame, run, keys: int) -> dict[int, np.ndarray]:
    """Sums of the vectors that ``run`` gives by key."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(raw.as_buffer(), float)
                sums[key] = sums[key] + values if key in sums else values
        yield _rows(sums)

    ddl = "key int, sums binary"
    parts = blocks.mapInArrow(run, ddl).repartition(max(1, min(keys, blocks.sparkSession.sparkContext.defaultParallelism)), "key")
    return {r["key"]: np.frombuffer(r["sums"], float) for r in parts.mapInArrow(add, ddl).collect()}


def _rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "sums"]
    )


def _by_space(fits: Sequence[Fit], states: Sequence[State], chosen: Sequence[int], points: Sequence[np.ndarray], bits: int):
    """For each space: fit numbers, points as columns, bits of the subsets, and weights of the two classes."""
    found = {}
    for space in {fits[i].space for i in chosen}:
        own = [k for k, i in enumerate(chosen) if fits[i].space == space]
        found[space] = (
            [chosen[k] for k in own], np.stack([points[k] for k in own], axis=1), np.array([fits[chosen[k]].subset % bits for k in own]),
            np.array([states[chosen[k]].weights for k in own]),
        )
    return found


def _objectives(blocks: DataFrame, grouped: dict) -> dict[int, np.ndarray]:
    """By fit: the loss and its gradient."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for space, x, sign, member in _blocks(batches, grouped):
            numbers, points, subsets, weights = grouped[space]
            loss, slope = bent_hinge(sign[:, None] * (x @ points))
            inside = (member[:, None] >> subsets[None, :]) & 1
            weight = inside * np.where(sign[:, None] > 0, weights[None, :, 1], weights[None, :, 0])
            values = np.vstack([(weight * loss).sum(axis=0), x.T @ (weight * slope * sign[:, None])])
            for k, i in enumerate(numbers):
                sums[i] = sums[i] + values[:, k] if i in sums else values[:, k].copy()
        yield _rows(sums)

    return _summed(blocks, run, sum(len(g[0]) for g in grouped.values()))


def _curvatures(blocks: DataFrame, spaces: set[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Eigenvalues and eigenvectors of each space's mean Gram matrix over the rows of any subset."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for space, x, _, member in _blocks(batches, spaces):
            own = x[member != 0].astype(float)
            values = np.append((own.T @ own).ravel(), len(own))
            sums[space] = sums[space] + values if space in sums else values
        yield _rows(sums)

    found = {}
    for space, values in _summed(blocks, run, len(spaces)).items():
        size = int(np.sqrt(len(values) - 1))
        found[space] = np.linalg.eigh(values[:-1].reshape(size, size) / max(values[-1], 1.0))
    return found


def _direction(state: State, curvature: tuple[np.ndarray, np.ndarray], scale: float) -> np.ndarray:
    """L-BFGS: two loops about the first guess (1 + scale * Gram)^-1."""
    q, used = state.gradient.copy(), []
    for s, y in reversed(state.history):
        a = (s @ q) / (s @ y)
        used.append(a)
        q -= a * y
    values, basis = curvature
    q = basis @ ((basis.T @ q) / (1.0 + scale * np.maximum(values, 0.0)))
    for (s, y), a in zip(state.history, reversed(used), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def solve(
    blocks: DataFrame, fits: Sequence[Fit], sizes: np.ndarray, tolerance: float = TOLERANCE, max_passes: int = 100, bits: int = 63
) -> list[State | None]:
    """A state for each fit, with the intercept last in ``w``; None where a class is missing. ``sizes`` as of ``subset_sizes``.

    ``converged`` tells whether a fit has met the tolerance; after ``max_passes`` passes it may not have.
    """
    states: list[State | None] = [None] * len(fits)
    live = [i for i, f in enumerate(fits) if sizes[f.subset].min() > 0]
    if not live:
        return states
    curvatures = _curvatures(blocks, {fits[i].space for i in live})
    for i in live:
        negative, positive = sizes[fits[i].subset]
        smallest = min(negative, positive)
        width = len(curvatures[fits[i].space][0])
        states[i] = State(np.zeros(width), (fits[i].cost * smallest / negative, fits[i].cost * smallest / positive))
    for _ in range(max_passes):
        active = [i for i in live if not states[i].done]
        if not active:
            break
        trials = [states[i].w if states[i].direction is None else states[i].w + states[i].length * states[i].direction for i in active]
        found = _objectives(blocks, _by_space(fits, states, active, trials, bits))
        for i, w in zip(active, trials, strict=True):
            penalty = np.append(w[:-1], 0.0)
            negative, positive = sizes[fits[i].subset]
            scale = fits[i].cost * 2 * min(negative, positive) / (4.0 * BEND)
            _move(states[i], w, found[i][0] + 0.5 * penalty @ penalty, found[i][1:] + penalty, curvatures[fits[i].space], scale, tolerance)
    return states


def _move(state: State, w: np.ndarray, value: float, gradient: np.ndarray, curvature, scale: float, tolerance: float) -> None:
    """Takes the trial point or shortens the step."""
    state.steps += 1
    if state.direction is not None:
        if value > state.value + 1e-4 * state.length * (state.gradient @ state.direction):
            state.length /= 2
            state.done = state.length < 1e-6
            return
        s, y = w - state.w, gradient - state.gradient
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            state.history = [*state.history[-_MEMORY + 1 :], (s, y)]
    state.w, state.value, state.gradient = w, value, gradient
    state.direction, state.length = _direction(state, curvature, scale), 1.0
    state.converged = state.done = bool(-(gradient @ state.direction) <= 2 * tolerance * max(abs(value), 1e-12))


def tallies(blocks: DataFrame, fits: Sequence[Fit], states: Sequence[State | None], bits: int = 63) -> np.ndarray:
    """(fits, 4): tp, fp, fn, tn over the rows outside each fit's own subset; zeros where nothing was fitted."""
    live = [i for i, s in enumerate(states) if s is not None]
    out = np.zeros((len(fits), 4), np.int64)
    if not live:
        return out
    grouped = _by_space(fits, states, live, [states[i].w for i in live], bits)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for space, x, sign, member in _blocks(batches, grouped):
            numbers, points, subsets, _ = grouped[space]
            outside = ((member[:, None] >> subsets[None, :]) & 1) == 0
            positive, true = x @ points >= 0, sign[:, None] > 0
            cells = [positive & true, positive & ~true, ~positive & true, ~positive & ~true]
            values = np.stack([(outside & c).sum(axis=0) for c in cells]).astype(float)
            for k, i in enumerate(numbers):
                sums[i] = sums[i] + values[:, k] if i in sums else values[:, k].copy()
        yield _rows(sums)

    for i, values in _summed(blocks, run, len(live)).items():
        out[i] = values.round()
    return out
