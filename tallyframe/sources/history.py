"""The append-only prediction history."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.pages import page_by_keys
from tallyframe.plans.skew import salted_join

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("created_at", T.StringType(), False),
        T.StructField("image_relpath", T.StringType(), False),
    ]
)
COLUMNS = HISTORY_SCHEMA.fieldNames()
MAX_PAGE = 200
NEWEST_FIRST = [("created_at", False), ("id", True)]
PREFIX = "_prefix"  # folder of a stored row: the first digits of its id's hash, after an "h"
PREFIX_DIGITS = 1  # 16 folders; set more before the first append of a history of billions of rows
URL_PREFIX, URL_SUFFIX = "/api/predictions/", "/image"


def id_prefix(column: Column) -> Column:
    return F.concat(F.lit("h"), F.substring(F.md5(column), 1, PREFIX_DIGITS))


def prefix_of(prediction_id: str) -> str:
    return "h" + hashlib.md5(prediction_id.encode()).hexdigest()[:PREFIX_DIGITS]


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows as they lie there, or None if there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_history(spark: SparkSession, path: str, prefixes: Sequence[str] | None = None) -> DataFrame:
    """The stored history, or an empty frame of its schema.

    With ``prefixes``, only their folders are read; a history stored without folders is read as a whole.
    """
    table = _table(spark, path)
    if table is None:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    if prefixes is not None and PREFIX in table.columns:
        table = table.where(F.col(PREFIX).isin(list(prefixes)))
    return migrate_history(table)


def migrate_history(df: DataFrame) -> DataFrame:
    """Any earlier layout in today's columns: ``prediction_id`` renamed, a missing path empty."""
    if "id" not in df.columns and "prediction_id" in df.columns:
        df = df.withColumnRenamed("prediction_id", "id")
    if "image_relpath" not in df.columns:
        df = df.withColumn("image_relpath", F.lit(""))
    return df.select(*COLUMNS)


def migrate_table(spark: SparkSession, source: str, target: str) -> None:
    """Writes the migrated rows to a new path; the caller then switches to it."""
    write_folders(migrate_history(spark.read.parquet(source)), target, "errorifexists")


def new_rows(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the batch whose id is not stored yet; the earliest row of an id stays.

    Rows of one id meet through a map-side combined minimum, and only the id
    column of the history is read.
    """
    first = (
        batch.groupBy("id")
        .agg(F.min(F.struct("created_at", *[c for c in COLUMNS if c not in ("id", "created_at")])).alias("r"))
        .select("id", "r.*")
        .select(*COLUMNS)
    )
    return first.join(history.select("id"), "id", "left_anti")


def append_history(df: DataFrame, path: str) -> None:
    """Adds the rows with new ids, sorted by id within files so that lookups skip row groups.

    Rows lie in folders by the hash of their id. The prefixes of the batch (16 ** PREFIX_DIGITS at most) come first, so
    ids are compared with those of the same folders only, and a small batch leaves most of the history unread.
    A history that was stored without folders goes on without.
    """
    spark = df.sparkSession
    batch = migrate_history(df)
    table = _table(spark, path)
    if table is not None and PREFIX not in table.columns:
        fresh = new_rows(batch, migrate_history(table))
        fresh.sortWithinPartitions("id").write.mode("append").parquet(path)
        return
    if table is None:
        fresh = new_rows(batch, spark.createDataFrame([], HISTORY_SCHEMA))
    else:
        touched = [r[0] for r in batch.select(id_prefix(F.col("id"))).distinct().collect()]
        fresh = new_rows(batch, read_history(spark, path, touched))
    write_folders(fresh, path, "append")


def write_folders(rows: DataFrame, path: str, mode: str) -> None:
    """Ranges of (prefix, id), so that a task writes few folders and no folder is one task's work."""
    placed = rows.withColumn(PREFIX, id_prefix(F.col("id")))
    placed.repartitionByRange(PREFIX, "id").sortWithinPartitions(PREFIX, "id").write.mode(mode).partitionBy(PREFIX).parquet(path)


def find_prediction(spark: SparkSession, path: str, prediction_id: str) -> DataFrame:
    """Zero or one row of a stored history; one folder is read."""
    return get_prediction(read_history(spark, path, [prefix_of(prediction_id)]), prediction_id)


def rejected_rows(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Rows whose primary key is stored already."""
    others = [c for c in batch.columns if c != "id"]
    return salted_join(batch, history.select("id"), ["id"], "left_semi", others)


def clear_counts(history: DataFrame) -> DataFrame:
    """Rows in all, and rows with a stored file: only the latter are reported as deleted."""
    return history.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(F.col("image_relpath") != "").alias("deleted_rows"),
    )


def stored_paths(history: DataFrame) -> DataFrame:
    return history.where(F.col("image_relpath") != "").select("image_relpath")


def clear_history(spark: SparkSession, path: str, paths_to: str | None = None) -> dict:
    """Empties the history. Stored paths go to ``paths_to``, as they may be many."""
    history = read_history(spark, path)
    counts = clear_counts(history).first().asDict()
    if paths_to is not None:
        stored_paths(history).write.mode("overwrite").parquet(paths_to)
    write_folders(spark.createDataFrame([], HISTORY_SCHEMA), path, "overwrite")
    return counts


def with_url(history: DataFrame) -> DataFrame:
    return history.withColumn("image_url", F.concat(F.lit(URL_PREFIX), "id", F.lit(URL_SUFFIX)))


def public_history(history: DataFrame) -> DataFrame:
    """Rows as shown outside: a URL instead of the stored path."""
    return with_url(history).drop("image_relpath")


def check_page(limit: int, offset: int, max_limit: int = MAX_PAGE) -> None:
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be 1..{max_limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def history_page(history: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; the id settles equal times."""
    check_page(limit, offset)
    return page_by_keys(history, NEWEST_FIRST, offset, limit)


def latest(history: DataFrame, n: int = MAX_PAGE) -> DataFrame:
    return page_by_keys(history, NEWEST_FIRST, 0, n)


def get_prediction(history: DataFrame, prediction_id: str) -> DataFrame:
    """Zero or one row; the filter reaches the Parquet row groups."""
    return with_url(history.where(F.col("id") == prediction_id))
