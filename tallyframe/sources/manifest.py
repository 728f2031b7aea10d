"""CSV manifests and split tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import normalize_id, normalize_name
from tallyframe.sources.records import csv_records

# Header names an id column may carry, delimiters tried, sample size in characters.
ID_HEADERS = ("image", "image_id", "img", "filename", "file", "id")
DELIMITERS = (",", ";", "\t", "|")
SNIFF_CHARS = 4096

POSITION = "_pos"
_QUOTED = re.compile(r'"(?:[^"]|"")*"')


def _text(spark: SparkSession, path: str) -> DataFrame | None:
    """The file as lines, or None when it is missing."""
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def sniff_sep(spark: SparkSession, path: str, default: str = ",") -> str:
    """Delimiter with a constant non-zero count per line in the head of the file, outside of quoted fields."""
    lines = _text(spark, path)
    if lines is None:
        return default
    head, size = [], 0
    # every line has a character, so more lines than characters are never needed
    for row in lines.where(F.trim("value") != "").limit(SNIFF_CHARS).toLocalIterator():
        if head and size + len(row["value"]) > SNIFF_CHARS:
            break
        head.append(row["value"])
        size += len(row["value"])
    plain = [_QUOTED.sub("", line) for line in head]
    best, best_count = default, 0
    for sep in DELIMITERS:
        counts = {line.count(sep) for line in plain}
        if len(counts) == 1 and (n := counts.pop()) > best_count:
            best, best_count = sep, n
    return best


def scan_text(spark: SparkSession, path: str) -> dict | None:
    """One distributed pass over the lines: line count, bad UTF-8, open quotes, blank lines."""
    lines = _text(spark, path)
    if lines is None:
        return None
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (
        lines.agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(~F.is_valid_utf8("value")).alias("undecodable"),
            F.count_if(quotes % 2 == 1).alias("open_quotes"),
            F.count_if(F.trim("value") == "").alias("blank"),
        )
        .first()
        .asDict()
    )


def read_manifest(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encodings: tuple[str, str] = ("UTF-8", "ISO-8859-1"),
    normalize: bool = False,
) -> DataFrame:
    """Manifest rows as text columns plus ``_pos``, the place in the file.

    The second encoding is used when the first leaves undecodable bytes. Files are read in parallel splits; if some
    line has an odd number of quotes, records are cut by :mod:`tallyframe.sources.records`. Only files with bare
    carriage returns as line ends are then read as a whole. A missing file gives an empty frame.
    """
    facts = scan_text(spark, path)
    if facts is None:
        return spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType())]))
    sep = sep or sniff_sep(spark, path)
    encoding = encodings[1] if facts["undecodable"] else encodings[0]
    rows = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("multiLine", facts["open_quotes"] > 0)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    if facts["open_quotes"] and not _bare_returns(spark, path):
        placed = _parsed(csv_records(spark, path, sep, encoding), rows.schema, sep)
    else:
        placed = rows.withColumn(
            POSITION,
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("line"),
            ),
        )
    return normalize_columns(placed, keep=(POSITION,)) if normalize else placed


def _bare_returns(spark: SparkSession, path: str) -> bool:
    lines = spark.read.option("lineSep", "\n").text(path)
    return not lines.where(F.col("value").rlike("\r(?!$)")).isEmpty()


def _parsed(records: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    """Records by the same parser that reads files; the columns are taken by position."""
    plain = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(schema))])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}
    cells = F.from_csv("record", plain.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    found = records.select(F.struct("file", "start", "line").alias(POSITION), cells.alias("_cells"))
    return found.select(*[F.col("_cells")[f.name].alias(c) for f, c in zip(plain, schema.names, strict=True)], POSITION)


def count_records(spark: SparkSession, path: str) -> int:
    """Records after the header, blank lines included."""
    facts = scan_text(spark, path)
    if facts is None:
        return 0
    if facts["open_quotes"] == 0:
        return max(facts["lines"] - 1, 0)
    return read_manifest(spark, path).count() + facts["blank"]


def normalize_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.toDF(*[c if c in keep else normalize_name(c) for c in df.columns])


def id_column(columns: Sequence[str]) -> str:
    """The first column with a known id header, else the first one."""
    known = [c for c in columns if c.strip().lower() in ID_HEADERS]
    return (known or list(columns))[0]


def manifest_index(manifest: DataFrame, id_col: str | None = None) -> DataFrame:
    """One row ``(id, meta)`` per item; the last row of an id wins, empty ids go."""
    columns = [c for c in manifest.columns if c != POSITION]
    id_col = id_col or id_column(columns)
    meta = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns if c != id_col]),
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns if c != id_col]),
    )
    return (
        manifest.select(normalize_id(F.col(f"`{id_col}`")).alias("id"), meta.alias("meta"), POSITION)
        .where(F.col("id") != "")
        .groupBy("id")
        .agg(F.max_by("meta", POSITION).alias("meta"))
    )


def read_splits(spark: SparkSession, folder: str, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """The split tables as one frame with a ``split`` column.

    Reads ``<name>.csv`` files where they exist, else Parquet partitioned by split.
    """
    try:
        frames = [
            spark.read.option("header", True).csv(f"{folder}/{n}.csv").withColumn("split", F.lit(n)) for n in names
        ]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.read.parquet(folder)
        raise
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(folder)
