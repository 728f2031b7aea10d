"""Joins that stay balanced when some keys hold much of the data.

A key is *hot* when it holds more than ``min_rows`` rows. It is spread over as
many tasks as it takes for each to get about that many. There is no limit to the number of hot keys or
of their tasks other than the size of the data; the table of hot keys is kept
small enough to broadcast by raising the rows per task, see :func:`hot_keys`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import ensure_checkpoint_dir

HOT_MIN_ROWS = 1_000_000
HOT_KEYS = 100_000


def key_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key; map-side combined, so a hot key sends one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def hot_keys(counts: DataFrame, keys: Sequence[str], min_rows: int | None = None, most: int | None = None) -> DataFrame | None:
    """The hot keys of a table counted as ``n`` per key, with ``salts``, the tasks of each; None if there are none.

    Should more than ``most`` keys be hot, a task gets ``1/most`` of their rows instead of ``min_rows``: no more
    than ``most`` keys can hold more than that, so the table stays small and no task gets more than such a share.
    """
    floor = HOT_MIN_ROWS if min_rows is None else min_rows
    most = HOT_KEYS if most is None else most
    ensure_checkpoint_dir(counts.sparkSession)
    hot = counts.where(F.col("n") > floor).select(*keys, "n").checkpoint()  # counted once, read twice
    found = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if not found["keys"]:
        return None
    target = max(floor, 1) if found["keys"] <= most else max(floor, -(-found["rows"] // most), 1)
    return hot.where(F.col("n") > target).select(*keys, F.ceil(F.col("n") / target).cast("bigint").alias("salts"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    rows: int | None = None,
    counts: DataFrame | None = None,
    min_rows: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Join whose hot left keys are spread over tasks of about ``min_rows`` rows: inner, left, left semi or left anti.

    ``right`` holds few rows per key (usually one). Its rows are repeated per
    salt for hot keys only, as often as their own count asks for. ``spread_by`` names left columns that tell the rows
    of one key apart; the salt is a hash of them, so a re-run task gives the
    same rows to the same partitions.

    A left side known to have at most ``min_rows`` ``rows`` has no hot key and
    joins as it is; otherwise its keys are counted, unless ``counts`` (the keys
    and ``n``) says how often they occur.
    """
    on = list(on)
    min_rows = HOT_MIN_ROWS if min_rows is None else min_rows
    if rows is not None and rows <= min_rows:
        return left.join(right, on, how)
    counts = key_counts(left.select(*on), on) if counts is None else counts
    hot = hot_keys(counts, on, min_rows, most)
    if hot is None:
        return left.join(right, on, how)
    # at most `most` rows, so they may be broadcast
    hot = F.broadcast(hot.select(*[F.col(c).alias(f"_hot_{i}") for i, c in enumerate(on)], F.col("salts").alias("_salts")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_hot_{i}")) for i, c in enumerate(on)])

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        return df.join(hot, same, "left").select(*df.columns, salt.alias("_salt"))

    salts = F.coalesce("_salts", F.lit(1))
    marked = salted(left, F.pmod(F.xxhash64(*spread_by), salts))
    spread = salted(right, F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return marked.join(spread, [*on, "_salt"], how).drop("_salt")
