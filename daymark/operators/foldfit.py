"""Elastic-net logistic regressions of all folds at once.

Folds share most of their rows: a year trains every later fold. So one pass over the rows, read as
they were written by year, serves all folds: a task multiplies its rows with the coefficients of every
fold at once and returns, for each fold it trains, the loss, the gradient and the curvature. Spark
adds them up element by element, and the driver takes a proximal Newton step for each fold: the
quadratic model with the two penalties is solved by coordinate descent, and a step that does not lower
the objective is halved. Passes depend on how hard the hardest fold is, not on the number of folds or rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

#: Largest change of a standardised coefficient at which a fold is done; passes at most; rows at once.
TOLERANCE, MOST_PASSES, ROWS = 1e-8, 100, 4096


@dataclass
class Linear:
    """Coefficients on standardised columns, and what is needed to improve them."""

    coefficients: np.ndarray
    intercept: float
    penalty: float
    l1_ratio: float
    #: How far the optimality conditions are from holding.
    violation: float = np.inf
    passes: int = 0

    def stage(self, columns: Sequence[str], name: str = "p_lr") -> SQLTransformer:
        """A saveable stage that adds P(up) from the standardised columns ``z_``."""
        terms = [f"{c!r}D * `z_{n}`" for n, c in zip(columns, self.coefficients.tolist()) if c]
        margin = " + ".join([f"{self.intercept!r}D", *terms])
        return SQLTransformer(statement=f"SELECT *, 1D / (1D + exp(-({margin}))) AS `{name}` FROM __THIS__")


@dataclass
class _State:
    """One fold between two passes: the last accepted point and the step under trial."""

    beta: np.ndarray
    step: np.ndarray
    size: float = 1.0
    objective: float = np.inf
    passes: int = 0
    done: bool = False
    gradient: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def trial(self) -> np.ndarray:
        return self.beta + self.size * self.step


def penalised(beta: np.ndarray, penalty: float, l1_ratio: float) -> float:
    inner = beta[1:]
    return penalty * (l1_ratio * np.abs(inner).sum() + (1 - l1_ratio) / 2 * (inner @ inner))


def newton_step(beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, penalty: float, l1_ratio: float) -> np.ndarray:
    """The step to the minimum of the quadratic model plus penalties; element 0 is not penalised."""
    l1, l2 = penalty * l1_ratio, penalty * (1 - l1_ratio)
    step, slope = np.zeros_like(beta), gradient.copy()
    diagonal = np.maximum(np.diag(curvature), 1e-12)
    for _ in range(5000):
        largest = 0.0
        for j in range(len(beta)):
            now = beta[j] + step[j]
            if j:
                want = diagonal[j] * now - slope[j]
                new = np.sign(want) * max(abs(want) - l1, 0.0) / (diagonal[j] + l2)
            else:
                new = now - slope[j] / diagonal[j]
            if (moved := new - now) != 0.0:
                step[j] += moved
                slope += curvature[:, j] * moved
                largest = max(largest, abs(moved))
        if largest < 1e-13:
            break
    return step


def violation(beta: np.ndarray, gradient: np.ndarray, penalty: float, l1_ratio: float) -> float:
    """Largest distance from the conditions that hold at the minimum."""
    l1, l2 = penalty * l1_ratio, penalty * (1 - l1_ratio)
    slope = gradient[1:] + l2 * beta[1:]
    off = np.where(beta[1:] != 0, np.abs(slope + l1 * np.sign(beta[1:])), np.maximum(np.abs(slope) - l1, 0.0))
    return float(max(abs(gradient[0]), off.max(initial=0.0)))


def _pass(data, folds: Sequence[int], trials: np.ndarray, curvature: bool) -> dict[int, np.ndarray]:
    """Sums over the training rows of each fold: loss, gradient and, if asked for, curvature.

    ``trials`` has a column a fold: intercept and coefficients, on that fold's standardised columns.
    """
    columns, years = data.columns, data.years
    stats = {f: {r.feature: (r.mean, r.scale) for r in data.stats[f]} for f in folds}
    mean = np.array([[stats[f][c][0] for f in folds] for c in columns])
    scale = np.array([[stats[f][c][1] for f in folds] for c in columns])
    # Rows are centred once for all folds, on the last one, so that no fold's sums cancel.
    centre, unit = mean[:, -1].copy(), scale[:, -1].copy()
    slopes = trials[1:] * unit[:, None] / scale
    start = trials[0] - ((mean - centre[:, None]) / scale * trials[1:]).sum(axis=0)
    weight = np.array([[data.weights[f].weight_down, data.weights[f].weight_up] for f in folds]).T
    first_fold = np.array(folds)
    p = len(columns)
    upper = np.triu_indices(p + 1)

    def run(batches):
        loss, slope = np.zeros(len(folds)), np.zeros((p + 1, len(folds)))
        bend = np.zeros((len(folds), p + 1, p + 1)) if curvature else None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                year, up = part.column(0).to_numpy(), part.column(1).to_numpy().astype(int)
                raw = np.stack([part.column(2 + j).to_numpy(zero_copy_only=False) for j in range(p)], axis=1)
                x = np.ones((len(raw), p + 1))
                x[:, 1:] = (np.where(np.isfinite(raw), raw, 0.0) - centre) / unit
                seed = (years.train_from <= year) & (year <= years.train_to)
                tested = (years.test_from <= year) & (year <= years.test_to)
                takes = seed[:, None] | (tested[:, None] & (year[:, None] < first_fold[None, :]))
                w = weight[up] * takes
                margin = x[:, 1:] @ slopes + start
                loss += (w * (np.logaddexp(0.0, margin) - up[:, None] * margin)).sum(axis=0)
                q = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                slope += x.T @ (w * (q - up[:, None]))
                if curvature:
                    for k, v in enumerate((w * q * (1 - q)).T):
                        bend[k] += (x * v[:, None]).T @ x
        out = [np.concatenate(([loss[k]], slope[:, k], bend[k][upper] if curvature else [])) for k in range(len(folds))]
        yield pa.RecordBatch.from_arrays([pa.array(list(folds), pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=["fold", "sums"])

    rows = data.frame.select(F.col("year").cast("int"), F.col("target").cast("int"), *[F.col(c).cast("double") for c in columns])
    summed = (
        rows.mapInArrow(run, "fold int, sums array<double>")
        .groupBy("fold")
        .agg(vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("sums"))["sum"]).alias("sums"))
    )
    out = {}
    # A row of (columns + 2)**2 / 2 numbers for each fold.
    for row in summed.collect():
        k = folds.index(row.fold)
        sums, n = np.array(row.sums), data.weights[row.fold].n_train
        # From the common centre to the fold's own: x_fold = (unit x + centre - mean) / scale.
        change = np.eye(p + 1)
        change[1:, 1:] = np.diag(unit / scale[:, k])
        change[1:, 0] = (centre - mean[:, k]) / scale[:, k]
        parts = [sums[:1] / n, change @ sums[1 : p + 2] / n]
        if curvature:
            whole = np.zeros((p + 1, p + 1))
            whole[upper] = sums[p + 2 :]
            whole += np.triu(whole, 1).T
            parts.append((change @ whole @ change.T).ravel() / n)
        out[row.fold] = np.concatenate(parts)
    return out


def fit_folds(
    data, folds: Sequence[int] | None = None, c: float = 1.0, l1_ratio: float = 0.5,
    tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES,
) -> dict[int, Linear]:
    """A fitted regression for each fold of ``data`` (see :func:`daymark.operators.ensemble.prepare`).

    The loss is the mean over balanced weights, so the penalty of n rows is 1 / (c n). Folds that are
    done are left out of further passes.
    """
    folds = list(folds or data.folds)
    width = len(data.columns) + 1
    penalty = {f: 1.0 / (c * data.weights[f].n_train) for f in folds}
    states = {f: _State(np.zeros(width), np.zeros(width)) for f in folds}
    out: dict[int, Linear] = {}
    for _ in range(most_passes):
        open_folds = [f for f in folds if not states[f].done]
        if not open_folds:
            break
        found = _pass(data, open_folds, np.stack([states[f].trial for f in open_folds], axis=1), True)
        for f in open_folds:
            state, sums = states[f], found[f]
            state.passes += 1
            trial = state.trial
            objective = sums[0] + penalised(trial, penalty[f], l1_ratio)
            if objective > state.objective + 1e-12 * abs(state.objective) and state.size > 1e-6:
                state.size /= 2
                continue
            gradient, curvature = sums[1 : width + 1], sums[width + 1 :].reshape(width, width)
            state.beta, state.objective, state.gradient, state.size = trial, objective, gradient, 1.0
            state.step = newton_step(trial, gradient, curvature, penalty[f], l1_ratio)
            state.done = bool(np.abs(state.step).max() < tolerance)
    for f, state in states.items():
        off = violation(state.beta, state.gradient, penalty[f], l1_ratio)
        out[f] = Linear(state.beta[1:], float(state.beta[0]), penalty[f], l1_ratio, off, state.passes)
    return out


def violations(data, fitted: dict[int, Linear]) -> dict[int, float]:
    """The optimality conditions of each fold, taken anew from the rows."""
    folds = list(fitted)
    trials = np.stack([np.concatenate(([fitted[f].intercept], fitted[f].coefficients)) for f in folds], axis=1)
    found = _pass(data, folds, trials, False)
    return {
        f: violation(trials[:, k], found[f][1:], fitted[f].penalty, fitted[f].l1_ratio) for k, f in enumerate(folds)
    }
