"""File listings, file bytes and decoded images."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import PAGE_IMAGE_EXTS, base_name, drop_suffix, file_suffix
from tallyframe.operators.features import orientation, rgb_bytes, to_gray, upright

FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("name", T.StringType()),
        T.StructField("stem", T.StringType()),
        T.StructField("ext", T.StringType()),
    ]
)

MAX_PAGE = 200


def _binary(spark: SparkSession, path: str | Sequence[str], recursive: bool) -> DataFrame | None:
    try:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", recursive)
            .load(path if isinstance(path, str) else list(path))
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def describe_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``name``, ``stem`` and ``ext`` to rows with a path."""
    return (
        df.withColumn("name", base_name(path))
        .withColumn("stem", drop_suffix("name"))
        .withColumn("ext", file_suffix("name"))
    )


def list_files(
    spark: SparkSession, folder: str, exts: Iterable[str] = PAGE_IMAGE_EXTS, recursive: bool = False
) -> DataFrame:
    """Files of a folder with one of the extensions; file contents are not read."""
    found = _binary(spark, folder, recursive)
    if found is None:
        return spark.createDataFrame([], FILE_SCHEMA)
    listed = describe_paths(found.select("path", "length", "modificationTime"))
    return listed.where(F.col("ext").isin(*exts))


def sorted_files(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower("name"), "path")


def read_images(spark: SparkSession, folder: str, drop_invalid: bool = True, upright_exif: bool = False) -> DataFrame:
    """Decoded images: ``path, height, width, data`` with RGB bytes row by row.

    ``upright_exif`` turns JPEG files by their orientation tag. The decoder does
    not give the tag, so file heads are read once more; only turned files move.
    """
    found = spark.read.format("image").option("dropInvalid", drop_invalid).load(folder)
    decoded = found.select(
        plain_uri("image.origin").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        rgb_bytes("image.nChannels", "image.data").alias("data"),
    )
    if not upright_exif:
        return decoded
    jpegs = spark.read.format("binaryFile").load(folder).where(file_suffix("path").isin("jpg", "jpeg"))
    tags = jpegs.select(plain_uri("path").alias("path"), orientation("content").alias("_tag")).where("_tag > 1")
    tagged = decoded.join(tags, "path", "left")
    turned = F.when(F.col("_tag").isNotNull(), upright("data", "height", "width", F.coalesce("_tag", F.lit(1))))
    same = F.struct("height", "width", "data")
    return tagged.select("path", F.coalesce(turned, same).alias("i")).select("path", "i.*")


def plain_uri(path: str) -> Column:
    """File URIs in one spelling: the image and the file source differ in slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded masks: ``path, height, width, data`` with one byte per pixel."""
    images = read_images(spark, folder)
    return images.withColumn("data", to_gray("data"))


def file_fingerprint(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Size, modification time and SHA-256 per file."""
    found = _binary(spark, paths, recursive=True)
    if found is None:
        raise FileNotFoundError(str(paths))
    return found.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
        F.sha2("content", 256).alias("sha256"),
    )


def fetch_bytes(spark: SparkSession, files: DataFrame, ids: Sequence[str], id_col: str = "stem") -> DataFrame:
    """Bytes of the files of one page of ids.

    The page is at most 200 ids. Only the pages' paths are opened: a filter on
    ``path`` would not reach the file scan.
    """
    if len(ids) > MAX_PAGE:
        raise ValueError(f"at most {MAX_PAGE} ids at a time")
    chosen = (
        files.where(F.col(id_col).isin(*ids))
        .groupBy(id_col)
        .agg(F.max_by("path", F.struct(F.lower("name"), "path")).alias("path"))
        .collect()
    )
    schema = "id string, path string, content binary"
    if not chosen:
        return spark.createDataFrame([], schema)
    by_path = F.create_map(*[F.lit(x) for r in chosen for x in (r["path"], r[id_col])])
    found = _binary(spark, [r["path"] for r in chosen], recursive=False)
    return found.select(by_path[F.col("path")].alias("id"), "path", "content")
