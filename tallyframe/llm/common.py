"""Small things the operators share: tables, scratch tables, Arrow helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import ensure_checkpoint_dir

_SCRATCH: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder of ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: what comes after survives lost executors without the work
    before it, and reads only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    cleanup = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this job are not needed after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Drops the scratch tables of this session; call it when the results have been written."""
    context = spark.sparkContext
    dropped = 0
    while _SCRATCH:
        path = context._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        dropped += bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
    return dropped


def utf8(column: str | Column) -> Column:
    """A text column as UTF-8 bytes, null as no bytes: what ASCII-only rules work on fastest."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that look at one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


_HELD: dict[str, Callable[[], None]] = {}


def claim_worker(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called by a task: what other operators keep in this Python worker between their tasks is dropped.

    ``forget`` drops what ``owner`` keeps itself, when another one's tasks come.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    if forget is not None:
        _HELD[owner] = forget


def list_slices(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column (no null lists)."""
    offsets = np.asarray(array.offsets)
    return offsets - offsets[0], array.flatten()


def with_field(df: DataFrame, column: str, ddl: str, name: str = "doc_id") -> T.StructType:
    """A schema that begins with a column of ``df``, whatever its type."""
    return T.StructType([T.StructField(name, df.schema[column].dataType), *T.StructType.fromDDL(ddl).fields])
