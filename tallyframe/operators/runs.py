"""Experiment runs and training histories: ranking, selection, early stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.plans.order import running_total, slice_ordered
from tallyframe.plans.skew import salted_join
from tallyframe.session import ensure_checkpoint_dir

MIN_DELTA = 1e-6
PATIENCE = 3
EPOCH_BLOCK = 10_000


def valid_runs(runs: DataFrame, metric: str = "val_f1_macro") -> DataFrame:
    return runs.dropna(subset=[metric])


def run_order(key: str = "experiment_id") -> list[Column]:
    """F1 down, accuracy down, time up, missing values last, then the key."""
    return [
        F.col("val_f1_macro").desc_nulls_last(),
        F.col("val_accuracy").desc_nulls_last(),
        F.col("runtime_sec").asc_nulls_last(),
        F.col(key),
    ]


def sort_runs(runs: DataFrame, key: str = "experiment_id") -> DataFrame:
    return runs.orderBy(*run_order(key))


def rank_runs(runs: DataFrame, metric: str = "val_f1_macro", key: str = "experiment_id", out: str = "rank_f1") -> DataFrame:
    """Competition rank by a metric, null for runs without it.

    Equal values share a rank, so ranks belong to the distinct values: they
    are counted, added up in descending order, and joined back.
    """
    counts = runs.groupBy(metric).agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counts, [F.col(metric).desc_nulls_last()], "n", "_upto")
    ranks = placed.where(F.col(metric).isNotNull()).select(metric, (F.col("_upto") - F.col("n") + 1).alias(out))
    return salted_join(runs, ranks, [metric], "left", [key], counts=placed.select(metric, "n"))


def select_best(runs: DataFrame, key: str = "experiment_id") -> DataFrame:
    return slice_ordered(valid_runs(runs), run_order(key), 0, 1)


def error_counts(runs: DataFrame, top: int = 10) -> DataFrame:
    """Failure reasons, most frequent first."""
    reasons = runs.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("runs"))
    return reasons.orderBy(F.col("runs").desc(), "error").limit(top)


def collect_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Run records with differing columns in one table."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), out: str = "weighted_mean") -> DataFrame:
    total = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.greatest(F.sum(weight), F.lit(1)))
    return df.groupBy(*by).agg(total.alias(out))


def early_stop(
    history: DataFrame,
    run: str = "run",
    epoch: str = "epoch",
    metric: str = "val_f1_macro",
    min_delta: float = MIN_DELTA,
    patience: int = PATIENCE,
    block: int = EPOCH_BLOCK,
) -> DataFrame:
    """Per run: best epoch, best value, epochs run, and whether patience ran out.

    A gain counts against the last accepted best, so epochs have to be folded
    in order. Repeated rows of an epoch are merged, then epochs are gathered by their position in
    blocks of at most ``block`` and the fold's state goes from block to block, until all runs have stopped;
    usual histories are one block, whatever their epochs' numbers. A row without an epoch is an error.
    """
    ensure_checkpoint_dir(history.sparkSession)
    number = F.coalesce(F.col(epoch).cast("bigint"), F.raise_error(F.lit("an epoch is missing")).cast("bigint"))
    epochs = history.groupBy(run, number.alias("e")).agg(F.max(F.col(metric).cast("double")).alias("v")).checkpoint()
    lengths = epochs.groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    if longest <= block:
        placed = epochs.withColumn("_block", F.lit(0))
    else:
        ranked = running_total(epochs.withColumn("_one", F.lit(1)), [F.col(run), F.col("e")], "_one", "_rank")
        firsts = ranked.groupBy(run).agg(F.min("_rank").alias("_first"))
        ranked = salted_join(ranked, firsts, [run], "inner", ["e"], counts=lengths)
        placed = ranked.withColumn("_block", F.floor((F.col("_rank") - F.col("_first")) / block))
    blocks = placed.groupBy(run, "_block").agg(F.array_sort(F.collect_list(F.struct("e", "v"))).alias("_epochs"))
    if longest > block:
        blocks = blocks.checkpoint()
    start = F.struct(
        F.lit(-1.0).alias("best"),
        F.lit(-1).cast("bigint").alias("best_epoch"),
        F.lit(0).alias("bad"),
        F.lit(0).cast("bigint").alias("ran"),
    )

    def step(s: Column, x: Column) -> Column:
        gain = x["v"] > s["best"] + min_delta
        nxt = F.struct(
            F.when(gain, x["v"]).otherwise(s["best"]).alias("best"),
            F.when(gain, x["e"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            F.when(gain, F.lit(0)).otherwise(s["bad"] + 1).alias("bad"),
            x["e"].alias("ran"),
        )
        return F.when(s["bad"] >= patience, s).otherwise(nxt)

    state = blocks.where("_block = 0").select(run, F.aggregate("_epochs", start, step).alias("s"))
    none = F.array().cast("array<struct<e:bigint,v:double>>")
    for at in range(1, -(-longest // block)):
        following = blocks.where(F.col("_block") == at).select(run, "_epochs")
        folded = F.aggregate(F.coalesce("_epochs", none), F.col("s"), step)
        state = state.join(following, run, "left").select(run, folded.alias("s")).checkpoint()
        if not state.where(F.col("s.bad") < patience).limit(1).count():
            break
    return state.select(
        run,
        F.col("s.best_epoch").alias("best_epoch"),
        F.col("s.best").alias("best_value"),
        F.col("s.ran").alias("epochs_ran"),
        (F.col("s.bad") >= patience).alias("stopped_early"),
    )


def _block(epoch: str, block: int) -> Column:
    return F.floor(F.col(epoch) / block).cast("bigint").alias("_block")


def run_summary(history: DataFrame, run: str = "run", **options) -> DataFrame:
    return early_stop(history, run=run, **options).select(run, "epochs_ran", "best_epoch", "best_value")


def throughput(history: DataFrame, run: str = "run", seconds: str = "seconds", n: str = "n") -> DataFrame:
    """Mean seconds per epoch and rows per second of each run."""
    return history.groupBy(run).agg(
        F.avg(seconds).alias("mean_epoch_sec"),
        F.try_divide(F.sum(n), F.greatest(F.sum(seconds), F.lit(1e-9))).alias("rows_per_sec"),
    )


def eta(
    history: DataFrame,
    total_epochs: int,
    run: str = "run",
    epoch: str = "epoch",
    seconds: str = "seconds",
    block: int = EPOCH_BLOCK,
) -> DataFrame:
    """Running mean of epoch time and the time left.

    Sums of whole epoch blocks come first, so a window holds one block of a
    run and a long run is spread over tasks.
    """
    marked = history.withColumn("_block", _block(epoch, block))
    sums = marked.groupBy(run, "_block").agg(F.sum(seconds).alias("_sum"), F.count(seconds).alias("_n"))
    earlier = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        run,
        "_block",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"),
    )
    so_far = Window.partitionBy(run, "_block").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_before") + F.coalesce(F.sum(seconds).over(so_far), F.lit(0.0))
    average = F.try_divide(total, F.col("_n_before") + F.count(seconds).over(so_far))
    return (
        marked.join(before, [run, "_block"])
        .withColumn("avg_epoch_sec", average)
        .withColumn("eta_sec", (F.lit(total_epochs) - F.col(epoch)) * F.col("avg_epoch_sec"))
        .select(*history.columns, "avg_epoch_sec", "eta_sec")
    )


def selection(runs: DataFrame, configs: DataFrame | None = None, key: str = "experiment_id") -> DataFrame:
    """The chosen run with the criterion, and its configuration when given."""
    best = select_best(runs, key).withColumn("criterion", F.lit("val_f1_macro, val_accuracy, runtime_sec"))
    if configs is None:
        return best
    # the one chosen key filters the configurations before they are joined
    return best.join(configs.where(F.col(key) == best.select(key).scalar()), key, "left")


def selection_report(runs: DataFrame, configs: DataFrame | None = None, key: str = "experiment_id") -> DataFrame:
    """The decision as numbered text lines: the best run, or the reasons why there is none."""
    chosen = selection(runs, configs, key)
    shown = [c for c in (key, "family", "val_f1_macro", "val_accuracy", "runtime_sec", "config") if c in chosen.columns]
    best_lines = chosen.select(
        F.posexplode(
            F.array(
                F.lit("# Selection decision"),
                F.concat(F.lit("- criterion: "), "criterion"),
                *[F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in shown],
            )
        ).alias("line_no", "line")
    )
    none = valid_runs(runs).limit(1).agg(F.count(F.lit(1))).scalar() == 0
    order = Window.orderBy(F.col("runs").desc(), "error")  # ten rows at most
    failures = error_counts(runs).where(none).select(
        F.row_number().over(order).alias("line_no"), F.concat(F.lit("- "), "error", F.lit(": "), F.col("runs").cast("string")).alias("line")
    )
    return best_lines.unionByName(failures)
