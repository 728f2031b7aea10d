"""JSON documents: contracts, label maps, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_doc(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, possibly over several lines, as a typed row."""
    return spark.read.option("multiLine", True).json(path)


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as text ``(path, document)``, for keys that vary."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")
    )


def as_json(df: DataFrame, out: str = "document") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def write_json_doc(df: DataFrame, path: str) -> None:
    """One JSON object per row; a contract or report frame has one row."""
    as_json(df, "value").write.mode("overwrite").text(path)


def json_number(document: str | Column, key: str) -> Column:
    return F.get_json_object(document, f"$.{key}").try_cast("double")
