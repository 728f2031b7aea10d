"""Linear models over blocks of rows, and proofs of how near a model is to the best one.

Rows are standardised and stacked into blocks once. A step is one pass over the blocks that adds up what
all classes need; partial sums are added in a tree, so the driver sees a few arrays of the model's size
however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
FAN_IN = 32  # partial sums that are added at once
HESSIAN_BYTES = 32 << 20  # second derivatives of all classes that a task may add up; beyond, products with them are formed
STEPS = 2.0 ** -np.arange(12)  # step lengths tried in one pass
SOLVED = 0.1, 200  # conjugate gradients: least reduction of the residual, most passes for a step


@dataclass
class Blocks:
    """Standardised training rows: ``x`` float64 by row, ``y`` int32; ``counts`` are the rows of each class."""

    df: DataFrame
    width: int
    counts: np.ndarray

    def added(self, work: Callable[[np.ndarray, np.ndarray, object], Sequence[np.ndarray]], shared: object) -> list[np.ndarray]:
        """The sums of ``work(x, y, shared)`` over all blocks, as flat arrays."""
        width = self.width
        sent = self.df.sparkSession.sparkContext.broadcast(shared)  # of the model's size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for batch in batches:
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    rows = np.frombuffer(x.as_buffer(), np.float64).reshape(-1, width)
                    part = [np.asarray(a, np.float64).ravel() for a in work(rows, np.frombuffer(y.as_buffer(), np.int32), sent.value)]
                    total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.list_(pa.float64())))], ["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for batch in batches:
                for row in batch.column("sums"):
                    part = [np.asarray(a.values) for a in row]
                    total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.list_(pa.float64())))], ["sums"])

        schema = "sums array<array<double>>"
        sums, parts = self.df.mapInArrow(run, schema), self.df.rdd.getNumPartitions()
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            sums = sums.repartition(parts).mapInArrow(add, schema)
        out = [[np.array(a) for a in row["sums"]] for row in sums.collect()]
        sent.destroy()
        return [np.sum(a, axis=0) for a in zip(*out, strict=True)]


def blocks(
    df: DataFrame, features: str, target: str, mean: Sequence[float], std: Sequence[float], n_classes: int
) -> Blocks:
    """Rows with features and a target in ``0..n_classes-1``, standardised and persisted as blocks.

    Rows without features or target take no part; numbers that are not finite, other widths and other targets are errors.
    """
    centre = np.asarray(mean, np.float64)
    scale = np.asarray(std, np.float64)
    scale = np.where(scale == 0, 1.0, scale)
    width = len(centre)
    per_block = max(1, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, y = batch.column("x"), np.asarray(batch.column("y"))
            values = np.asarray(lists.flatten()).astype(np.float64)
            if not (np.diff(np.asarray(lists.offsets)) == width).all() or not np.isfinite(values).all():
                raise ValueError(f"features have to be {width} finite numbers")
            if len(y) and not (0 <= y.min() and y.max() < n_classes):
                raise ValueError(f"targets have to be 0 to {n_classes - 1}")
            x = (values.reshape(-1, width) - centre) / scale
            for i in range(0, len(y), per_block):
                part = y[i : i + per_block].astype(np.int32)
                cells = [pa.array([x[i : i + per_block].tobytes()]), pa.array([part.tobytes()]), pa.array([np.bincount(part, minlength=n_classes)])]
                yield pa.RecordBatch.from_arrays(cells, ["x", "y", "counts"])

    kept = df.where(F.col(features).isNotNull() & F.col(target).isNotNull())
    rows = kept.select(F.col(features).alias("x"), F.col(target).cast("int").alias("y"))
    stacked = rows.mapInArrow(run, "x binary, y binary, counts array<bigint>").persist()
    sums = [F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(n_classes)]
    return Blocks(stacked, width, np.array(stacked.agg(*sums).first(), np.int64))


@dataclass
class LinearModel:
    """A score per class: standardised features times ``weights`` (width x classes) plus ``bias``; the highest wins."""

    weights: np.ndarray
    bias: np.ndarray
    features: str = "features_vec"

    def transform(self, df: DataFrame) -> DataFrame:
        weights, bias = self.weights, self.bias

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.stack(x.to_numpy()) @ weights + bias))

        scored = df.withColumn("rawPrediction", scores("_z"))
        return scored.withColumn("prediction", F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1.0)


# -- squared hinge, one class against the rest ----------------------------------------------------------
def _hinge(x: np.ndarray, y: np.ndarray, w: np.ndarray, costs: np.ndarray, cost: float):
    sign = np.where(y[:, None] == np.arange(w.shape[1]), 1.0, -1.0)
    slack = np.maximum(0.0, 1 - sign * (x @ w[:-1] + w[-1]))
    return sign, slack, np.where(sign > 0, costs, cost)


def _hinge_sums(x: np.ndarray, y: np.ndarray, shared: tuple) -> list[np.ndarray]:
    """Losses, gradients and, if asked for, second derivatives."""
    w, costs, cost, curved = shared
    sign, slack, weight = _hinge(x, y, w, costs, cost)
    pull = -2 * weight * slack * sign
    out = [(weight * slack * slack).sum(0), np.vstack([x.T @ pull, pull.sum(0)])]
    if curved:
        wide = np.hstack([x, np.ones((len(x), 1))])
        held = 2 * weight * (slack > 0)
        out.append(np.stack([(wide * held[:, k : k + 1]).T @ wide for k in range(w.shape[1])]))
    return out


def _hinge_products(x: np.ndarray, y: np.ndarray, shared: tuple) -> list[np.ndarray]:
    """Second derivatives times a direction per class."""
    w, costs, cost, direction = shared
    _, slack, weight = _hinge(x, y, w, costs, cost)
    turned = 2 * weight * (slack > 0) * (x @ direction[:-1] + direction[-1])
    return [np.vstack([x.T @ turned, turned.sum(0)])]


def _hinge_along(x: np.ndarray, y: np.ndarray, shared: tuple) -> list[np.ndarray]:
    """Losses at several steps along a direction."""
    w, costs, cost, direction, steps = shared
    sign, _, weight = _hinge(x, y, w, costs, cost)
    here, there = x @ w[:-1] + w[-1], x @ direction[:-1] + direction[-1]
    return [np.stack([(weight * np.maximum(0.0, 1 - sign * (here + t * there)) ** 2).sum(0) for t in steps])]


def fit_squared_hinge(
    data: Blocks, C: float = 1.0, balanced: bool = True, bound: float = 1e-6, max_steps: int | None = None
) -> tuple[LinearModel, np.ndarray]:
    """One-vs-rest fit of ``|w|^2 / 2 + C * sum of c_i * max(0, 1 - y_i (w x_i + b))^2`` and the gap proved per class.

    The bias is part of ``w``, for a constant feature of 1. With ``balanced``, ``c_i`` is rows / (classes * rows of the
    class) for the rows of the class and 1 for the rest.

    The objective is at least as curved as ``|w|^2 / 2``, so with gradient ``g`` it lies at most ``|g|^2 / 2`` above the
    optimum. That bound, as a share of the objective, is the gap; Newton steps go on until it is ``bound`` or less for
    every class, or ``max_steps`` are done, or rounding leaves no step that improves any open class.
    """
    n, k = data.width + 1, len(data.counts)
    present = data.counts > 0
    costs = np.full(k, C)
    if balanced:
        costs = np.where(present, C * data.counts.sum() / (max(1, int(present.sum())) * np.maximum(data.counts, 1)), C)
    curved = 8 * k * n * n <= HESSIAN_BYTES
    w = np.zeros((n, k))

    def sums(w: np.ndarray):
        if not data.counts.sum():
            return np.zeros(k), np.zeros((n, k)), np.zeros((k, n, n))
        loss, pull, *rest = data.added(_hinge_sums, (w, costs, C, curved))
        return loss + (w * w).sum(0) / 2, w + pull.reshape(n, k), rest[0].reshape(k, n, n) if curved else None

    value, gradient, second = sums(w)
    done = 0
    while True:
        gap = (gradient * gradient).sum(0) / 2 / np.maximum(value, np.finfo(float).tiny)
        open_ = gap > bound
        if not open_.any() or done == max_steps:
            break
        if curved:
            step = np.stack([np.linalg.solve(second[i] + np.eye(n), -gradient[:, i]) for i in range(k)], 1)
        else:
            step = _conjugate(data, w, costs, C, gradient, open_)
        step[:, ~open_] = 0
        tried = sums(w + step)
        slope = (gradient * step).sum(0)
        worse = open_ & (tried[0] > value + 1e-4 * slope)
        if worse.any():  # too long a step for some class: all lengths at once
            losses = data.added(_hinge_along, (w, costs, C, step, STEPS))[0].reshape(len(STEPS), k)
            values = losses + ((w[None] + STEPS[:, None, None] * step[None]) ** 2).sum(1) / 2
            best = values.argmin(0)
            length = np.where(worse, np.where(values.min(0) < value, STEPS[best], 0.0), 1.0)
            if not (length[open_] > 0).any():
                break
            step = step * length
            tried = sums(w + step)
        w, (value, gradient, second) = w + step, tried
        done += 1
    return LinearModel(w[:-1], w[-1]), gap


def _conjugate(data: Blocks, w: np.ndarray, costs: np.ndarray, cost: float, gradient: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Newton directions of all open classes by conjugate gradients, a pass over the blocks for each step."""
    step, rest = np.zeros_like(w), -gradient * open_
    direction, size = rest.copy(), (rest * rest).sum(0)
    first = size.copy()
    for _ in range(SOLVED[1]):
        turned = direction + data.added(_hinge_products, (w, costs, cost, direction))[0].reshape(w.shape)
        along = (direction * turned).sum(0)
        length = np.divide(size, along, out=np.zeros_like(size), where=along > 0)
        step, rest = step + length * direction, rest - length * turned
        new = (rest * rest).sum(0)
        if (new <= SOLVED[0] ** 2 * first).all():
            break
        direction = rest + np.divide(new, size, out=np.zeros_like(size), where=size > 0) * direction
        size = new
    return step


# -- multinomial logistic loss ---------------------------------------------------------------------------
def _logistic_sums(x: np.ndarray, y: np.ndarray, shared: tuple) -> list[np.ndarray]:
    w, b, costs = shared
    scores = x @ w + b
    scores -= scores.max(1, keepdims=True)
    spread = np.exp(scores)
    total = spread.sum(1, keepdims=True)
    pull = spread / total
    loss = np.log(total[:, 0]) - scores[np.arange(len(y)), y]
    pull[np.arange(len(y)), y] -= 1
    pull *= costs[y][:, None]
    return [np.array([(loss * costs[y]).sum()]), x.T @ pull, pull.sum(0)]


def logistic_gap(data: Blocks, weights: np.ndarray, bias: np.ndarray, C: float = 1.0, balanced: bool = False) -> float:
    """How far ``|w|^2 / 2 + C * sum of c_i * log loss`` may be above its optimum, as a share of it, by one pass.

    The predicted probabilities are a point of the dual problem; the difference to its value is ``|g_w|^2 / 2 + b g_b``
    with the gradients by weights and biases. Biases have no penalty, so the dual point counts only against models whose
    biases lie within twice the largest one here, plus 1: that adds at most this size times the sum of ``|g_b|``.
    """
    present = data.counts > 0
    costs = np.full(len(data.counts), C)
    if balanced:
        costs = np.where(present, C * data.counts.sum() / (max(1, int(present.sum())) * np.maximum(data.counts, 1)), C)
    bias = bias - bias.mean()
    loss, by_weight, by_bias = data.added(_logistic_sums, (weights, bias, costs))
    by_weight = by_weight.reshape(weights.shape) + weights
    box = 2 * np.abs(bias).max() + 1
    above = (by_weight**2).sum() / 2 + bias @ by_bias + box * np.abs(by_bias).sum()
    return float(above / (loss[0] + (weights**2).sum() / 2))
