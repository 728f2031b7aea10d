"""Multiclass, ranking and mask metrics.

Everything multiclass derives from the counts per (truth, prediction) pair,
which one map-side combined aggregation gives.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.scores import cross_entropy, entropy, margin, softmax, top_k
from tallyframe.functions.values import argmax
from tallyframe.plans.order import slice_ordered

CLIP = 1e-9


def confusion_counts(scored: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return scored.groupBy(F.col(y).cast("int").alias("y_true"), F.col(p).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(scored: DataFrame, n_classes: int, normalize: bool = False, **cols: str) -> DataFrame:
    """All ``n_classes`` x ``n_classes`` cells, zeros included."""
    cells = scored.sparkSession.range(n_classes * n_classes).select(
        F.floor(F.col("id") / n_classes).cast("int").alias("y_true"), (F.col("id") % n_classes).cast("int").alias("y_pred")
    )
    grid = cells.join(confusion_counts(scored, **cols), ["y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
    if normalize:
        rows = F.sum("n").over(Window.partitionBy("y_true"))  # n_classes cells
        grid = grid.withColumn("share", F.col("n") / F.greatest(rows.cast("double"), F.lit(CLIP)))
    return grid


def confusion_wide(scored: DataFrame, n_classes: int, **cols: str) -> DataFrame:
    grid = confusion_matrix(scored, n_classes, **cols)
    return grid.groupBy("y_true").pivot("y_pred", list(range(n_classes))).agg(F.sum("n"))


def class_facts(counts: DataFrame) -> DataFrame:
    """True positives, support and predictions per label seen on either side."""
    sides = counts.select(
        F.inline(
            F.array(
                _side("y_true", F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0), F.col("n"), F.lit(0)),
                _side("y_pred", F.lit(0), F.lit(0), F.col("n")),
            )
        )
    )
    return sides.groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )


def _side(label: str, tp: Column, support: Column, predicted: Column) -> Column:
    return F.struct(
        F.col(label).alias("label"),
        tp.cast("bigint").alias("tp"),
        support.cast("bigint").alias("support"),
        predicted.cast("bigint").alias("predicted"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label; an undefined one is 0."""
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return class_facts(counts).select(
        "label",
        "tp",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"),
        "support",
    )


def evaluate(scored: DataFrame, **cols: str) -> DataFrame:
    """One row: rows, accuracy and macro-F1 over the labels seen."""
    return class_scores(confusion_counts(scored, **cols)).agg(
        F.sum("support").alias("rows"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
    )


def accuracy(scored: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return scored.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def f1_macro(scored: DataFrame, **cols: str) -> DataFrame:
    return evaluate(scored, **cols).select("f1_macro")


def classification_report(scored: DataFrame, names: Mapping[int, str] | None = None, **cols: str) -> DataFrame:
    """Per class and summary rows from one pass over the scored rows."""
    name = F.col("label").cast("string")
    if names:
        pairs = [F.lit(x) for k, v in names.items() for x in (int(k), v)]
        name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("label")), name)
    row = F.struct(name.alias("name"), "precision", "recall", "f1", "support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    def summary(label: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(
            F.lit(label).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.sum("support").alias("support")
        )

    none = F.lit(None).cast("double")
    # one row per label is gathered: their number is the number of classes
    totals = class_scores(confusion_counts(scored, **cols)).agg(
        F.collect_list(row).alias("rows"),
        summary("accuracy", none, none, _ratio(F.sum("tp"), F.sum("support"))).alias("a"),
        summary("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")).alias("m"),
        summary("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")).alias("w"),
    )
    return totals.select(F.inline(F.concat("rows", F.array("a", "m", "w"))))


def report_lines(report: DataFrame) -> DataFrame:
    """The report as numbered text lines with four decimals."""
    summaries = ("accuracy", "macro avg", "weighted avg")
    place = F.when(F.col("name").isin(*summaries), 1).otherwise(0)
    numbers = [F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("")) for c in ("precision", "recall", "f1")]
    cells = [F.rpad("name", 24, " ")] + [F.lpad(n, 10, " ") for n in [*numbers, F.col("support").cast("string")]]
    order = Window.orderBy(place, "name")  # one row per class
    return report.select(F.row_number().over(order).alias("line_no"), F.concat(*cells).alias("line"))


def majority_class(train: DataFrame, target: str = "target_index") -> DataFrame:
    """The most frequent class; the lower index wins a tie."""
    counts = train.groupBy(F.col(target).cast("int").alias("majority")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("rows").desc(), "majority").limit(1)


def majority_baseline(train: DataFrame, other: DataFrame, target: str = "target_index", out: str = "y_pred") -> DataFrame:
    """Other rows with the train majority as their prediction."""
    return other.withColumn(out, majority_class(train, target).select("majority").scalar())


def evaluate_logits(df: DataFrame, logits: str = "logits", y: str = "target_index") -> DataFrame:
    return evaluate(df.select(F.col(y).alias("y_true"), argmax(logits).alias("y_pred")))


def error_analysis(
    scored: DataFrame, probs: str, k: int, key: str, y: str = "y_true", p: str = "y_pred", by: str = "wrong"
) -> DataFrame:
    """The ``k`` most confident misses, or the ``k`` most uncertain rows."""
    facts = (
        scored.withColumn("confidence", F.get(F.col(probs), F.col(p)))
        .withColumn("entropy", entropy(probs))
        .withColumn("margin", margin(probs))
    )
    if by == "wrong":
        return slice_ordered(facts.where(F.col(y) != F.col(p)), [F.col("confidence").desc(), F.col(key)], 0, k)
    return slice_ordered(facts, [F.col("entropy").desc(), F.col(key)], 0, k)


def top_k_labels(scored: DataFrame, probs: str, k: int, key: str) -> DataFrame:
    """``k`` rows per item: place, label, score."""
    ranked = scored.select(key, F.posexplode(top_k(probs, k)).alias("pos", "t"))
    return ranked.select(key, (F.col("pos") + 1).alias("place"), F.col("t.label").alias("label"), F.col("t.score").alias("score"))


def mask_metrics(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """IoU and Dice of two 0/1 arrays per row; two empty masks agree fully."""
    both = F.aggregate(F.zip_with(pred, truth, lambda a, b: a * b), F.lit(0), lambda acc, v: acc + v)

    def area(c: str) -> Column:
        return F.aggregate(F.col(c), F.lit(0), lambda acc, v: acc + v)

    joint = F.col("_p") + F.col("_t")
    return (
        df.withColumn("_i", both)
        .withColumn("_p", area(pred))
        .withColumn("_t", area(truth))
        .withColumn("iou", F.coalesce(F.try_divide(F.col("_i"), joint - F.col("_i")), F.lit(1.0)))
        .withColumn("dice", F.coalesce(F.try_divide(2 * F.col("_i"), joint), F.lit(1.0)))
        .drop("_i", "_p", "_t")
    )


def mask_means(measured: DataFrame) -> DataFrame:
    return measured.agg(F.count(F.lit(1)).alias("rows"), F.avg("iou").alias("iou_mean"), F.avg("dice").alias("dice_mean"))


def mask_area_ratio(mask: str | Column) -> Column:
    """Share of the pixels that are set, of a 0/1 array."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.try_divide(F.aggregate(m, F.lit(0), lambda acc, v: acc + v), F.size(m))


def mask_coverage(audited: DataFrame) -> DataFrame:
    """Share of the rows with an image that have a mask."""
    return audited.where("image_exists").agg(F.avg(F.col("mask_exists").cast("double")).alias("mask_coverage"))


def scaled(logits: str, temperature: float) -> Column:
    return F.transform(F.col(logits), lambda v: v / F.lit(float(temperature)))


def fit_temperature(
    df: DataFrame, n_classes: int, temperatures: list[float], logits: str = "logits", y: str = "target_index"
) -> DataFrame:
    """Loss at each temperature, from one pass over the rows; the best first.

    The grid is the caller's and short, so each temperature is one aggregate.
    """
    losses = [
        F.struct(
            F.lit(float(t)).alias("temperature"), cross_entropy(scaled(logits, t), y, n_classes).alias("loss")
        ).alias(f"t{i}")
        for i, t in enumerate(temperatures)
    ]
    grid = df.agg(*losses).select(F.inline(F.array(*[f"t{i}" for i in range(len(temperatures))])))
    return grid.orderBy("loss", "temperature")


def with_probabilities(df: DataFrame, logits: str = "logits", temperature: float = 1.0, out: str = "probability") -> DataFrame:
    return df.withColumn(out, softmax(scaled(logits, temperature)))
