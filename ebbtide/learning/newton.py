"""Logistic regression by Newton steps: each one is one pass over the rows.

Every task sums its rows' gradient and Hessian; the sums of all tasks are added by
cell, so what reaches the driver is a matrix of the features, whatever the rows.
A step that doesn't lower the loss is halved. Where a first-order learner takes up
to a thousand passes, some ten are enough.

Rows with a missing feature, label or weight take no part. A feature that has one
value only gets no weight.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fitted:
    """Coefficients of standardised features after each step; ``steps[-1]`` is the fit."""

    names: tuple[str, ...]
    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    steps: tuple[tuple[float, ...], ...]  # the intercept first
    loss: tuple[float, ...]  # before each step
    converged: bool

    def probability(self, columns: Mapping[str, Column] | None = None) -> Column:
        """Score as a plain expression of the features; ``columns`` tells where these are, if not under their names."""
        z = F.lit(self.steps[-1][0])
        for name, m, d, b in zip(self.names, self.mean, self.deviation, self.steps[-1][1:]):
            if d > 0:
                own = F.col(name) if columns is None else columns[name]
                z = z + F.lit(b) * (own.cast("double") - F.lit(m)) / F.lit(d)
        return 1.0 / (1.0 + F.exp(-z))


def _rows(train: DataFrame, names: Sequence[str], label: str, weight: str | None) -> DataFrame:
    kept = train.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)], F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    for c in kept.columns:
        kept = kept.where(F.col(c).isNotNull() & ~F.isnan(c))
    return kept


def _sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the rows at the coefficients ``at``."""
    n = len(at)

    def run(batches):
        total = np.zeros((n, n + 2))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = np.column_stack([np.ones(batch.num_rows), *columns[:-2]])
            x[:, 1:] = (x[:, 1:] - mean) * scale
            y, w = columns[-2], columns[-1]
            z = x @ at
            p = 0.5 * (1 + np.tanh(z / 2))
            total[:, :n] += x.T @ (x * (w * p * (1 - p))[:, None])
            total[:, n] += x.T @ (w * (p - y))
            total[0, n + 1] += float(w @ (np.logaddexp(0, z) - y * z))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], names=["i", "j", "v"])

    added = rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((n, n + 2))
    for r in added.collect():  # one row for each cell of the matrix
        total[r["i"], r["j"]] = r["v"]
    return float(total[0, n + 1]), total[:, n], total[:, :n]


def fit_newton(
    train: DataFrame, names: Sequence[str], label: str = "is_churn", weight: str | None = None, penalty: float = 1.0, max_steps: int = 50, tolerance: float = 1e-9
) -> Fitted:
    """Minimise the weighted sum of log losses and half the penalty times the squared coefficients, the intercept free.

    Ends when every part of a step is below ``tolerance``; 0 takes exactly ``max_steps`` steps.
    """
    rows = _rows(train, names, label, weight)
    facts = rows.agg(*[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.avg, F.stddev_samp)]).first()
    if names and facts["avg0"] is None:
        raise ValueError("no rows to fit")
    mean = np.array([facts[f"avg{i}"] for i in range(len(names))])
    deviation = np.array([facts[f"stddev_samp{i}"] or 0.0 for i in range(len(names))])
    scale = np.divide(1.0, deviation, out=np.zeros(len(names)), where=deviation > 0)
    shrink = np.concatenate([[0.0], np.full(len(names), penalty)])
    at, steps, losses, converged = np.zeros(len(names) + 1), [], [], False
    loss, slope, curve = _sums(rows, mean, scale, at)
    while len(steps) < max_steps and not converged:
        losses.append(loss)
        step = np.linalg.lstsq(curve + np.diag(shrink), slope + shrink * at, rcond=None)[0]
        before = at
        for _ in range(30):
            at = before - step
            own, slope, curve = _sums(rows, mean, scale, at)
            loss = own + 0.5 * float(shrink @ (at * at))
            if loss <= losses[-1] + 1e-9 * abs(losses[-1]):
                break
            step = step / 2
        steps.append(tuple(float(b) for b in at))
        converged = bool(np.abs(step).max() < tolerance)
    return Fitted(tuple(names), tuple(mean.tolist()), tuple(deviation.tolist()), tuple(steps), tuple(losses), converged)


def step_table(fitted: Fitted, train: DataFrame) -> DataFrame:
    """``step`` (from 1), ``feature`` and ``coefficient`` of the standardised features."""
    rows = [(k, n, b) for k, at in enumerate(fitted.steps, 1) for n, b in zip(("intercept", *fitted.names), at)]
    return train.sparkSession.createDataFrame(rows, "step int, feature string, coefficient double")
