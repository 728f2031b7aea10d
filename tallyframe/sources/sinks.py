"""Table, report and score sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(lines: DataFrame, path: str, order: str = "line_no", text: str = "line") -> None:
    """A text report in line order. Reports hold a bounded number of lines."""
    lines.orderBy(order).select(F.col(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_scores(df: DataFrame, path: str, logits: str = "logits", target: str = "target_index") -> None:
    """Logits as ``array<double>`` beside their labels."""
    df.withColumn(logits, F.col(logits).cast("array<double>")).withColumn(
        target, F.col(target).cast("int")
    ).write.mode("overwrite").parquet(path)
