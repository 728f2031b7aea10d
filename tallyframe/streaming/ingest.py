"""New prediction files into the history, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyframe.sources.history import HISTORY_SCHEMA, append_history


def ingest_history(
    spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int = 1000
) -> StreamingQuery:
    """Reads waiting files in bounded batches and appends rows with new ids.

    Ids are checked against the history itself, so no de-duplication state
    grows with the stream and a batch that is run again adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        append_history(batch, target)

    return (
        spark.readStream.schema(HISTORY_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
