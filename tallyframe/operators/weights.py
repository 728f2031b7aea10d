"""Class distributions, imbalance weights and weighted draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.plans.order import carry_last, hash_order, running_total

LINE_BITS = 46  # weights become whole lengths on a line of about 2**46, so sums are exact


def class_distribution(df: DataFrame, n_classes: int, target: str = "target_index") -> DataFrame:
    """Rows per class index, zero for classes without rows: exactly ``n_classes`` rows."""
    counts = df.groupBy(F.col(target).cast("int").alias("target_index")).agg(F.count(F.lit(1)).alias("rows"))
    slots = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("target_index"))
    return slots.join(counts, "target_index", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def balanced_weights(df: DataFrame, target: str = "target_index") -> DataFrame:
    """``n / (classes present * rows of the class)`` per class present."""
    counts = df.groupBy(F.col(target).cast("int").alias("target_index")).agg(F.count(F.lit(1)).alias("rows"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("rows").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("rows"))
    return counts.withColumn("weight", weight)


def mean_one_weights(df: DataFrame, n_classes: int, target: str = "target_index") -> DataFrame:
    """Inverse frequencies with empty classes counted as one row, divided by their mean."""
    everything = Window.partitionBy()  # n_classes rows
    raw = F.sum("rows").over(everything) / (F.lit(n_classes) * F.greatest("rows", F.lit(1)))
    return (
        class_distribution(df, n_classes, target)
        .withColumn("_raw", raw)
        .withColumn("weight", F.col("_raw") / F.avg("_raw").over(everything))
        .drop("_raw")
    )


def attach_weights(df: DataFrame, weights: DataFrame, n_classes: int, target: str = "target_index") -> DataFrame:
    """Row weights by class. The broadcast side is re-keyed to ``n_classes`` rows at most."""
    slots = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(target))
    one_each = weights.groupBy(F.col("target_index").alias(target)).agg(F.min("weight").alias("weight"))
    return df.join(F.broadcast(slots.join(one_each, target)), target, "left")


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, chance proportional to ``weight``: ``(draw, key)``.

    Rows lie on a line in hash order, each as long as its weight, scaled by a power of two to the sum of all; draw
    ``i`` is a point on it and takes the row it falls on. Rows of one key are one piece of the line.

    Rows and points are put in order together, in ranges that a sample of both has cut: a task gets its share of them
    whether the points fall on one row or on all. Rows too light for the scale share one piece at the line's
    end; a draw that falls there is made again among these rows, on a line of their own. Only if all of them weigh
    less than ``2**-(LINE_BITS + 1)`` of the whole together they are never drawn. Rows without a positive weight
    take no part.
    """
    positive = df.where(F.col(weight) > 0).groupBy(F.col(key).alias("_key")).agg(F.sum(weight).alias("_weight"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"))
    return _drawn(positive, draws, seed, str(seed)).select("draw", F.col("_key").alias(key))


def _drawn(rows: DataFrame, draws: DataFrame, seed: int, line: str) -> DataFrame:
    """``draw, _key`` for rows ``_key, _weight``; ``line`` names the line that draws fall on."""
    mass, count = rows.agg(F.sum("_weight"), F.count(F.lit(1))).first()
    if not mass:
        raise ValueError("no row has a positive weight")
    bits = max(LINE_BITS, count.bit_length() + 1)  # the heaviest row always has a length
    scale = 2.0 ** math.floor(bits - math.log2(mass))
    lengths = rows.select("_key", "_weight", F.round(F.col("_weight") * scale).cast("bigint").alias("_len"), hash_order(seed, "_key").alias("_h"))
    light = F.col("_len") == 0
    total, rest = lengths.agg(F.sum("_len"), F.round(F.sum(F.when(light, F.col("_weight"))) * scale).cast("bigint")).first()
    placed = running_total(lengths.where(~light).select("_key", "_len", "_h"), [F.col("_h"), F.col("_key")], "_len", "_upto")
    points = draws.select("draw", draw_point(F.col("draw"), line, total + (rest or 0)).alias("_at"))
    no_draw, no_key = F.lit(None).cast("bigint").alias("draw"), F.lit(None).cast(rows.schema["_key"].dataType).alias("_key")
    marks = placed.select(no_draw, (F.col("_upto") - F.col("_len")).alias("_at"), F.lit(True).alias("_row"), "_key").unionByName(
        points.where(F.col("_at") < total).select("draw", "_at", F.lit(False).alias("_row"), no_key)
    )
    # a row comes before the points at its very start
    found = carry_last(marks.withColumn("_point", ~F.col("_row")), ["_at", "_point"], "_row", "_key", "_hit")
    drawn = found.select("draw", F.col("_hit").alias("_key"))
    if not rest:
        return drawn
    again = points.where(F.col("_at") >= total).select("draw")
    return drawn.unionByName(_drawn(lengths.where(light).select("_key", "_weight"), again, seed, f"{line}/light"))


def draw_point(draw: Column, line: int | str, total: int) -> Column:
    """A point in ``0 .. total - 1`` from the hash of a line's name and a draw's number."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(line)), F.lit("draw"), draw.cast("string")))
    return F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint"), F.lit(total))
