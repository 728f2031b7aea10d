"""Reproducible splits, samples and split reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.plans.order import hash_order, running_total, slice_ordered
from tallyframe.plans.skew import key_counts, salted_join
from tallyframe.session import ensure_checkpoint_dir

RATIOS = (70, 15, 15)
NAMES = ("train", "val", "test")
MAX_BROADCAST_STRATA = 50_000
HASH_DIGITS = 4  # hash prefixes of this many hex digits cut a stratum into 65536 even pieces


def _prefix(hashed: str | Column, digits: int = HASH_DIGITS) -> Column:
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def stratified_split(
    df: DataFrame,
    stratum: str | Column,
    key: str,
    ratios: tuple[int, int, int] = RATIOS,
    seed: int = 42,
    allocate: str = "largest_remainder",
    out: str = "split",
    max_broadcast: int = MAX_BROADCAST_STRATA,
) -> DataFrame:
    """Exact stratified split that does not depend on partitioning.

    Rows of a stratum are ordered by ``md5(seed:key)``. A window per stratum
    would put the largest class in one task. Instead, rows are counted per hash
    prefix; the two prefixes in which a stratum's cuts fall are ranked to find
    the last train and last val row, and every row compares itself with those.
    No row moves. With more strata than may be broadcast, rows move once, by
    (stratum, prefix), and are ranked inside their prefix.

    ``largest_remainder`` gives val and test the floor of their share of all
    rows, spread over the strata by remainder, and train the rest.
    ``per_class`` cuts every stratum at its own percentages.
    """
    if sum(ratios) != 100:
        raise ValueError("ratios are whole percentages that add up to 100")
    ensure_checkpoint_dir(df.sparkSession)
    value = F.col(stratum) if isinstance(stratum, str) else stratum
    marked = (
        df.withColumn("_s", F.coalesce(value.cast("string"), F.lit("\u0000")))
        .withColumn("_h", hash_order(seed, key))
        .withColumn("_b", _prefix("_h"))
    )
    # at most 65536 rows per stratum, read several times below
    pieces = marked.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    in_order = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(in_order), F.lit(0)))
    strata = pieces.groupBy("_s").agg(F.sum("_n").alias("_size"))
    few = strata.count() <= max_broadcast
    cuts = _remainder_cuts(strata, ratios, few) if allocate == "largest_remainder" else _class_cuts(strata, ratios)
    placed = starts.join(cuts, "_s")
    if few:
        name = _by_last_rows(marked, placed, key)
    else:
        rank = F.col("_start") + F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))
        ranked = marked.join(placed.drop("_n"), ["_s", "_b"]).withColumn("_rank", rank)
        name = ranked.withColumn("_train", F.col("_rank") <= F.col("_train")).withColumn("_val", F.col("_rank") <= F.col("_val"))
    part = F.when(F.col("_train"), NAMES[0]).when(F.col("_val"), NAMES[1]).otherwise(NAMES[2])
    return name.withColumn(out, part).select(*df.columns, out)


def _by_last_rows(marked: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Adds whether a row is at or before its stratum's last train row, and last val row."""

    def holds(cut: str) -> Column:
        return (F.col("_start") < F.col(cut)) & (F.col(cut) <= F.col("_start") + F.col("_n"))

    # two pieces per stratum at most
    edges = placed.where(holds("_train") | holds("_val")).select(
        "_s",
        "_b",
        F.when(holds("_train"), F.col("_train") - F.col("_start")).alias("_t"),
        F.when(holds("_val"), F.col("_val") - F.col("_start")).alias("_v"),
    )
    near = marked.select("_s", "_b", "_h", F.col(key).alias("_key")).join(F.broadcast(edges), ["_s", "_b"])
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "_key"))
    place = F.struct("_h", "_key")
    last = near.withColumn("_rank", rank).groupBy("_s").agg(
        F.max(F.when(F.col("_rank") == F.col("_t"), place)).alias("_last_train"),
        F.max(F.when(F.col("_rank") == F.col("_v"), place)).alias("_last_val"),
    )
    here = F.struct(F.col("_h"), F.col(key).alias("_key"))
    return (
        marked.join(F.broadcast(last), "_s", "left")
        .withColumn("_train", F.coalesce(here <= F.col("_last_train"), F.lit(False)))
        .withColumn("_val", F.coalesce(here <= F.col("_last_val"), F.lit(False)))
    )


def _class_cuts(strata: DataFrame, ratios: tuple[int, int, int]) -> DataFrame:
    size = F.col("_size")
    return strata.select(
        "_s", _share(size, ratios[0]).alias("_train"), _share(size, ratios[0] + ratios[1]).alias("_val")
    )


def _share(n: Column, percent: int) -> Column:
    """Whole percent of a count, rounded down in whole numbers."""
    return ((n * percent - (n * percent) % 100) / 100).cast("bigint")


def _remainder_cuts(strata: DataFrame, ratios: tuple[int, int, int], few: bool) -> DataFrame:
    """Last train and last val rank per stratum. A ``few`` strata are ranked by one window, more by ranges."""
    size = F.col("_size")
    shares = strata.withColumn("_v0", _share(size, ratios[1])).withColumn("_t0", _share(size, ratios[2]))
    sums = shares.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_size", "_v0", "_t0")]).first()

    def allotted(df: DataFrame, base: str, percent: int, room: Column, out: str) -> DataFrame:
        missing = sums["_size"] * percent // 100 - sums[base]
        order = [room.desc(), ((size * percent) % 100).desc(), F.col("_s")]
        if few:
            ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
        else:
            ranked = running_total(df.withColumn("_one", F.lit(1)), order, "_one", "_rank").drop("_one")
        return ranked.withColumn(out, F.col(base) + (F.col("_rank") <= missing).cast("bigint")).drop("_rank")

    with_val = allotted(shares, "_v0", ratios[1], size > F.col("_v0") + F.col("_t0"), "_v")
    with_test = allotted(with_val, "_t0", ratios[2], size > F.col("_v") + F.col("_t0"), "_t")
    return with_test.select("_s", (size - F.col("_v") - F.col("_t")).alias("_train"), (size - F.col("_t")).alias("_val"))


def multilabel_split(df: DataFrame, label_cols: Sequence[str], key: str, **options) -> DataFrame:
    """Split by label set. Sets with few rows cannot follow the ratios closely."""
    on = [F.when(F.col(f"`{c}`").cast("double") == 1.0, F.lit(c)) for c in label_cols]
    return stratified_split(df, F.concat_ws("|", *on), key, **options)


def group_split(
    df: DataFrame, group: str, ratios: tuple[int, int, int] = RATIOS, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Split in which no group is divided: each group falls where its hash says.

    A row needs nothing but its own group id, so no rows move.
    """
    place = F.pmod(F.conv(F.substring(hash_order(seed, group), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    name = F.when(place < ratios[0], NAMES[0]).when(place < ratios[0] + ratios[1], NAMES[1])
    return df.withColumn(out, name.otherwise(NAMES[2]))


def split_distribution(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows and share per split and class."""
    counts = key_counts(df, [split, target], "rows")
    within = F.sum("rows").over(Window.partitionBy(split))
    return counts.withColumn("share", F.col("rows") / within)


def split_missingness(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """Percent of nulls per split and column."""
    shares = df.groupBy(split).agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols])
    return shares.unpivot([split], list(cols), "column", "share").select(
        split, "column", (F.col("share") * 100).alias("missing_pct")
    )


def rare_policy(
    df: DataFrame, label: str, min_count: int, spread_by: Sequence[str], action: str = "other", other: str = "other"
) -> DataFrame:
    """Labels with fewer rows than ``min_count`` become ``other`` or lose their rows."""
    counts = key_counts(df, [label])
    rare = counts.where(F.col("n") < min_count).select(label, F.lit(True).alias("_rare"))
    if action == "drop":
        return salted_join(df, rare, [label], "left_anti", spread_by, counts=counts)
    if action != "other":
        raise ValueError(f"unknown action {action!r}")
    marked = salted_join(df, rare, [label], "left", spread_by, counts=counts)
    return marked.withColumn(label, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(label))).select(*df.columns)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A seeded sample without replacement, the same on any partitioning."""
    return slice_ordered(df, [hash_order(seed, key), F.col(key)], 0, n)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return slice_ordered(df, order, 0, k)
