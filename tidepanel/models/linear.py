"""Ridge and logistic regression for all folds and feature sets at once, from sums over rows.

Rows are packed once.  Ridge needs one pass for the matrices of second moments of every fold, which also give the
standardisation; a Newton step of the logistic regression is one more pass that sums loss, gradient and curvature of all open
problems (feature set and fold).  What reaches the driver depends on folds, sets and features, never on rows.

Rows with the same fold bits are summed together, so overlapping train periods cost one product each row.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.models.boosting import SEGMENT, _as_binary, _as_matrix, _summed, _sums_row

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACKED_SCHEMA = "ROW_ID long, y double, train int, valid int, x binary"
SCORED_SCHEMA = "set int, fold int, ROW_ID long, y double, p1 double"


def packed_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """ROW_ID, y, fold bits and the features of a row as one binary value; NULL counts as 0.  Kept, as every pass reads it."""
    S.require_columns(df, [S.ROW_ID, label, "train", "valid", *features], "linear models")

    def task(batches):
        for batch in batches:
            values = np.column_stack([batch.column(4 + j).to_numpy(zero_copy_only=False) for j in range(len(features))]).reshape(batch.num_rows, len(features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _as_binary(values)], names=["ROW_ID", "y", "train", "valid", "x"])

    rows = df.where((F.col("train") != 0) | (F.col("valid") != 0)).select(
        F.col(S.ROW_ID).cast("long"),
        F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"),
        F.col("train").cast("int"),
        F.col("valid").cast("int"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(features)],
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(task, PACKED_SCHEMA).repartition(parts, S.ROW_ID).persist(StorageLevel.MEMORY_AND_DISK)


def _arrays(batch: pa.RecordBatch, width: int):
    ids, y, train, valid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    return ids, y, train, valid, _as_matrix(batch.column(4), np.float64, width)


def _sum_of(rows: DataFrame, length: int, add) -> np.ndarray:
    """``add(total, batch)`` over all batches, summed over all tasks."""

    def task(batches):
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        for segment, begin in enumerate(range(0, length, SEGMENT)):
            yield _sums_row(segment, 0, total[begin : begin + SEGMENT])

    return _summed(rows, task, length)


@dataclass(frozen=True)
class Moments:
    """Training rows of one fold: count, means of features and label, centred second moments (label last)."""

    n: int
    mean: np.ndarray
    second: np.ndarray


def fold_moments(rows: DataFrame, width: int, folds: int) -> list[Moments]:
    """One pass for a common centre, so that large means cost no digits, and one for the matrices."""
    size = width + 1

    def add_sums(total, batch):
        _, y, train, _, x = _arrays(batch, width)
        inside = train != 0
        total += np.concatenate([[inside.sum()], x[inside].sum(axis=0), [y[inside].sum()]])

    sums = _sum_of(rows, size + 1, add_sums)
    if not sums[0]:
        raise ValueError("no training rows")
    centre, block = sums[1:] / sums[0], 1 + size + size * size

    def add_products(total, batch):
        _, y, train, _, x = _arrays(batch, width)
        z = np.column_stack([x, y]) - centre
        for bits in np.unique(train[train != 0]).tolist():
            own = z[train == bits]
            sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            for f in range(folds):
                if bits >> f & 1:
                    total[f * block : (f + 1) * block] += sums

    found = _sum_of(rows, folds * block, add_products).reshape(folds, block)
    moments = []
    for own in found:
        n = int(own[0])
        if not n:
            raise ValueError("a fold has no training rows")
        shift = own[1 : 1 + size] / n
        moments.append(Moments(n, centre + shift, own[1 + size :].reshape(size, size) - n * np.outer(shift, shift)))
    return moments


def ridge_of(moments: Moments, columns: Sequence[int], alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of least squares with ``alpha * |w|^2`` on some of the columns; the intercept is free."""
    at = list(columns)
    own = moments.second[np.ix_(at, at)] + alpha * np.eye(len(at))
    w = np.linalg.lstsq(own, moments.second[at, -1], rcond=None)[0]
    return w, float(moments.mean[-1] - w @ moments.mean[at])


@dataclass
class Logit:
    """One problem: a feature set (column numbers) on one fold; ``w`` holds the intercept first, for standardised features."""

    set: int
    fold: int
    columns: list[int]
    mean: np.ndarray
    scale: np.ndarray
    n: int
    w: np.ndarray
    last: np.ndarray | None = None
    loss: float = np.inf
    steps: int = 0
    done: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x[:, self.columns] - self.mean) / self.scale])


def fit_logits(rows: DataFrame, width: int, folds: int, sets: Sequence[Sequence[int]], C: float = 1.0, max_iter: int = 1000, tolerance: float = 1e-9) -> list[Logit]:
    """Standardised logistic regressions of every set and fold: minimum of ``C * sum(loss) + |w|^2 / 2``, the intercept free.

    Damped Newton steps, all open problems in one job; a problem ends when no entry of its mean gradient exceeds ``tolerance``.
    """
    problems = []
    for f, m in enumerate(fold_moments(rows, width, folds)):
        spread = np.sqrt(np.maximum(np.diag(m.second) / m.n, 0.0))
        share = min(max(m.mean[-1], 1e-12), 1 - 1e-12)
        for s, columns in enumerate(sets):
            at = list(columns)
            scale = np.where(spread[at] > 1e-12 * np.maximum(1.0, np.abs(m.mean[at])), spread[at], 1.0)
            w = np.concatenate([[np.log(share / (1 - share))], np.zeros(len(at))])
            problems.append(Logit(s, f, at, m.mean[at], scale, m.n, w))
    for _ in range(max_iter):
        open_now = [p for p in problems if not p.done]
        if not open_now:
            break
        lengths = [1 + len(p.w) + len(p.w) ** 2 for p in open_now]
        ends = np.cumsum(lengths)

        def add(total, batch):
            _, y, train, _, x = _arrays(batch, width)
            for p, end, length in zip(open_now, ends, lengths):
                at = train >> p.fold & 1 == 1
                z, own = p.design(x[at]), y[at]
                margin = z @ p.w
                chance = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                loss = (np.logaddexp(0.0, margin) - own * margin).sum()
                curve = (z * (chance * (1 - chance))[:, None]).T @ z
                total[end - length : end] += np.concatenate([[loss], z.T @ (chance - own), curve.ravel()])

        sums = _sum_of(rows, int(ends[-1]), add)
        for p, end, length in zip(open_now, ends, lengths):
            _step(p, sums[end - length : end], C, tolerance)
    return problems


def _step(p: Logit, sums: np.ndarray, C: float, tolerance: float) -> None:
    """A Newton step, or half the last one back if that raised the objective."""
    k = len(p.w)
    pull = np.concatenate([[0.0], p.w[1:]]) / C
    loss = sums[0] + (p.w[1:] ** 2).sum() / (2 * C)
    if p.last is not None and loss > p.loss + 1e-9 * abs(p.loss):
        p.w = (p.w + p.last) / 2
        return
    gradient = sums[1 : 1 + k] + pull
    if np.abs(gradient).max() <= tolerance * p.n:
        p.done = True
        return
    curve = sums[1 + k :].reshape(k, k) + np.diag(np.concatenate([[0.0], np.ones(k - 1)]) / C)
    p.last, p.loss, p.steps = p.w, loss, p.steps + 1
    p.w = p.w - np.linalg.lstsq(curve, gradient, rcond=None)[0]


def score_logits(rows: DataFrame, width: int, problems: Sequence[Logit]) -> DataFrame:
    """set, fold (from 1), ROW_ID, y, p1, prediction of the validation rows of every problem."""

    def task(batches):
        for batch in batches:
            ids, y, _, valid, x = _arrays(batch, width)
            for p in problems:
                at = np.flatnonzero(valid >> p.fold & 1 == 1)
                if len(at):
                    chance = 1 / (1 + np.exp(-np.clip(p.design(x[at]) @ p.w, -500, 500)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p.set, np.int32)), pa.array(np.full(len(at), p.fold + 1, np.int32)), pa.array(ids[at]), pa.array(y[at]), pa.array(chance)],
                        names=["set", "fold", "ROW_ID", "y", "p1"],
                    )

    return rows.mapInArrow(task, SCORED_SCHEMA).withColumn(S.PREDICTION, F.when(F.col(S.PROBABILITY) > 0.5, 1).otherwise(0))
