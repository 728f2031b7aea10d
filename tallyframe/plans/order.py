"""Ranks, running totals, pages and quantiles over a whole table.

An unpartitioned window puts every row in one task. These helpers instead
range-partition the rows, fix that layout with a checkpoint, add up per
partition (one small row each) and rank inside the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.session import ensure_checkpoint_dir, shuffle_partitions

SHALLOW_ROWS = 10_000
WINDOW_ROWS = 1_000_000


def hash_order(seed: int, *cols: str | Column) -> Column:
    """A reproducible pseudo-random sort key: md5 of ``seed:key``."""
    keys = [c if isinstance(c, Column) else F.col(c) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def _ranged(df: DataFrame, order: Sequence[Column], parts: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = parts or shuffle_partitions(spark)
    laid_out = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return laid_out.checkpoint()


def running_total(
    df: DataFrame, order: Sequence[Column], value: str, out: str, parts: int | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows up to and including this one.

    ``order`` has to be a total order over the rows.
    """
    ranged = _ranged(df, order, parts)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(before), "_part")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_part", "_before")
    )


def carry_last(
    df: DataFrame, order: Sequence[str], marker: str, value: str, out: str, parts: int | None = None
) -> DataFrame:
    """Rows without ``marker`` and, as ``out``, the ``value`` of the last row with it before them in ``order``.

    Ranges are cut by a sample of all rows, so however rows and markers lie, tasks get about the same number. Rows are
    shuffled and sorted once; the partitions pass on their last value, one row each. Rows before the first marked one
    get null.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = parts or shuffle_partitions(spark)
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions(*order).checkpoint()
    last = ranged.where(marker).groupBy("_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    ends = spark.range(parts).select(F.col("id").cast("int").alias("_part")).join(last, "_part", "left")
    before = ends.select("_part", F.last("_last", ignorenulls=True).over(earlier)[value].alias("_before"))
    kept = [c for c in df.columns if c not in (marker, value)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("_part", T.IntegerType()),
                           T.StructField("_found", T.BooleanType()), T.StructField(out, df.schema[value].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest: pa.Array | None = None  # the value to go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            marked = np.asarray(batch.column(marker).to_numpy(zero_copy_only=False), bool)
            at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
            values = batch.column(value)
            found = at >= 0 if latest is None else np.ones(len(at), bool)
            # the earlier value stands in front of those of the batch
            known = pa.concat_arrays([values.slice(0, 1) if latest is None else latest, values])
            filled = known.take(pa.array(at + 1))
            rows = pa.array(np.flatnonzero(~marked))
            columns = [batch.column(c).take(rows) for c in [*kept, "_part"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found).take(rows), filled.take(rows)], [*kept, "_part", "_found", out])
            if at[-1] >= 0:
                latest = values.slice(int(at[-1]), 1)

    filled = ranged.mapInArrow(run, schema).join(F.broadcast(before), "_part", "left")
    return filled.select(*kept, F.when(F.col("_found"), F.col(out)).otherwise(F.col("_before")).alias(out))


def slice_ordered(
    df: DataFrame,
    order: Sequence[Column],
    offset: int,
    limit: int,
    shallow: int = SHALLOW_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Rows ``offset .. offset + limit`` in ``order``, at any depth.

    A shallow slice is a bounded top-k heap per task. A deep one reads the
    range partitions' sizes and ranks only the partitions the slice touches.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    if offset + limit <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    ranged = _ranged(df, order, parts)
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    start, starts = 0, {}
    for part, n in sizes:
        if start < offset + limit and start + n > offset:
            starts[part] = start
        start += n
    if not starts:
        return ranged.drop("_part").where(F.lit(False))
    base = F.coalesce(*[F.when(F.col("_part") == p, F.lit(s).cast("long")) for p, s in starts.items()])
    position = base + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.where(F.col("_part").isin(list(starts)))
        .withColumn("_position", position)
        .where((F.col("_position") > offset) & (F.col("_position") <= offset + limit))
        .orderBy("_position")
        .drop("_part", "_position")
    )


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, tuple[int, int]], error: float = 1e-3
) -> DataFrame:
    """Linearly interpolated quantiles per column; ``probs`` maps name -> (numerator, denominator).

    A sketch gives a narrow bracket around each quantile, one pass counts the
    rows below and inside it, and only the rows inside are put in order. A
    bracket that misses its rank is opened to the whole column, so the result
    is exact whatever the sketch says.
    """
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    around = {
        name: (max(n / d - 2 * error, 0.0), min(n / d + 2 * error, 1.0)) for name, (n, d) in probs.items()
    }
    edges = sorted({e for pair in around.values() for e in pair})
    accuracy = F.lit(int(1 / error))
    sketch = numbers.agg(*[F.percentile_approx(c, F.lit(edges), accuracy).alias(c) for c in cols]).first()
    brackets = {}
    for c in cols:
        at_edge = dict(zip(edges, sketch[c] or [], strict=False))
        if at_edge:  # else the column has no values
            brackets |= {(c, name): (at_edge[low], at_edge[high]) for name, (low, high) in around.items()}
    tallies = [F.count(F.col(c)).alias(f"n_{c}") for c in cols]
    for (c, name), (low, high) in brackets.items():
        tallies.append(F.count_if(F.col(c) < low).alias(f"below_{c}_{name}"))
        tallies.append(F.count_if(F.col(c).between(low, high)).alias(f"inside_{c}_{name}"))
    counted = numbers.agg(*tallies).first().asDict()

    # per column and quantile: the two ranks around it, and the rows to look at
    plan, inside, most = [], [], 0
    for (c, name), (low, high) in brackets.items():
        n, d = probs[name]
        last = counted[f"n_{c}"] - 1
        first_rank, second_rank = last * n // d, -(-last * n // d)
        below, within = counted[f"below_{c}_{name}"], counted[f"inside_{c}_{name}"]
        if not below <= first_rank <= second_rank < below + within:
            low, high, below, within = float("-inf"), float("inf"), 0, last + 1
        most = max(most, within)
        plan.append((c, name, first_rank - below, second_rank - below, (last * n % d) / d))
        inside.append((c, name, F.col(c).between(low, high)))
    spark = df.sparkSession
    if not plan:
        return spark.createDataFrame([], "column string, " + ", ".join(f"{p} double" for p in probs))
    any_inside = reduce(lambda a, b: a | b, [test for _, _, test in inside])
    values = [
        F.when(test, F.struct(F.lit(c).alias("column"), F.lit(name).alias("name"), F.col(c).alias("value")))
        for c, name, test in inside
    ]
    picked = numbers.where(any_inside).select(F.explode_outer(F.array(*values)).alias("r")).where(F.col("r").isNotNull())
    counts = picked.select("r.*").groupBy("column", "name", "value").agg(F.count(F.lit(1)).alias("n"))
    group = ["column", "name"]
    if most <= WINDOW_ROWS:  # counted above, so each window is known to be small
        in_group = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        located = counts.withColumn("_upto", F.sum("n").over(in_group))
    else:
        placed = running_total(counts, [F.col(c) for c in (*group, "value")], "n", "_end")
        # one row per column and quantile
        firsts = placed.groupBy(*group).agg(F.min(F.col("_end") - F.col("n")).alias("_first"))
        located = placed.join(F.broadcast(firsts), group).withColumn("_upto", F.col("_end") - F.col("_first"))
    wanted = spark.createDataFrame(plan, "column string, name string, lo bigint, hi bigint, part double")
    located = located.join(F.broadcast(wanted), group)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.col("value")))

    found = located.groupBy(*group).agg(at("lo").alias("v"), at("hi").alias("w"), F.first("part").alias("part"))
    value = F.col("v") + (F.col("w") - F.col("v")) * F.col("part")
    return found.groupBy("column").pivot("name", list(probs)).agg(F.first(value))
