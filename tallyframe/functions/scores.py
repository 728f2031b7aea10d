"""Losses and per-row measures on score arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def log_sum_exp(logits: str | Column) -> Column:
    a = _col(logits)
    top = F.array_max(a)
    return top + F.log(array_sum(F.transform(a, lambda v: F.exp(v - top))))


def log_softmax(logits: str | Column) -> Column:
    a = _col(logits)
    norm = log_sum_exp(a)
    return F.transform(a, lambda v: v - norm)


def softmax(logits: str | Column) -> Column:
    return F.transform(log_softmax(logits), lambda v: F.exp(v))


def _weights(w: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in w])


def cross_entropy(
    logits: str | Column,
    y: str | Column,
    n_classes: int,
    smoothing: float = 0.0,
    weights: Sequence[float] | None = None,
) -> Column:
    """Aggregate: smoothed, weighted cross-entropy; the mean divides by the true classes' weights."""
    a, label = _col(logits), _col(y)
    norm = log_sum_exp(a)
    own = norm - F.get(a, label)
    if weights is None:
        spread = norm * n_classes - array_sum(a)
        row = own * (1.0 - smoothing) + spread * (smoothing / n_classes)
        return F.avg(row)
    w = _weights(weights)
    spread = array_sum(F.zip_with(a, w, lambda v, x: (norm - v) * x))
    row = own * F.get(w, label) * (1.0 - smoothing) + spread * (smoothing / n_classes)
    return F.sum(row) / F.sum(F.get(w, label))


def focal_loss(
    logits: str | Column, y: str | Column, gamma: float = 2.0, weights: Sequence[float] | None = None
) -> Column:
    """Aggregate: focal loss with a plain mean."""
    a, label = _col(logits), _col(y)
    log_p = F.get(a, label) - log_sum_exp(a)
    row = -F.pow(1.0 - F.exp(log_p), F.lit(float(gamma))) * log_p
    if weights is not None:
        row = row * F.get(_weights(weights), label)
    return F.avg(row)


def entropy(probs: str | Column) -> Column:
    return -array_sum(F.transform(_col(probs), lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))))


def margin(probs: str | Column) -> Column:
    """Gap between the two largest scores."""
    ranked = F.sort_array(_col(probs), asc=False)
    return F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))


def top_k(probs: str | Column, k: int) -> Column:
    """``array<struct<label,score>>`` of the k largest scores, the lower label first on ties."""
    pairs = F.transform(_col(probs), lambda p, i: F.struct((-p).alias("neg"), i.alias("label")))
    return F.transform(
        F.slice(F.array_sort(pairs), 1, k),
        lambda s: F.struct(s["label"].alias("label"), (-s["neg"]).alias("score")),
    )
