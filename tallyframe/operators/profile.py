"""Column facts, role inference, distributions and audit totals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.names import ALL_IMAGE_EXTS, looks_like_filename, norm_stem
from tallyframe.functions.values import as_double, coerce_int0
from tallyframe.plans.order import exact_quantiles, hash_order, slice_ordered
from tallyframe.plans.reduce import bits_for, keep_possible, key_bits
from tallyframe.plans.skew import key_counts

# Thresholds of the inference rules and report lengths.
ONE_HOT_SHARE = 0.90
ZERO_ONE_SHARE = 0.98
MASK_NAME_BONUS = 0.15
NUMERIC_SHARE = 0.80
KEY_MATCH_GATE = 0.20
TOP_MISSING = 25
TOP_CANDIDATES = 10
TOP_VALUES = 15
TOP_DUPLICATES = 10
# Keys of the audit summary, in their order.
PLACES = ("created_at_utc", "project_root", "groundtruth_csv", "images_dir", "masks_dir")
SUMMARY_KEYS = (
    *PLACES, "csv_rows", "csv_cols", "image_files_on_disk", "mask_files_on_disk", "image_col_inferred",
    "mask_col_inferred", "mode_inferred", "target_encoding", "label_cols_count", "meta_cols_count",
    "audit_total_rows", "audit_images_missing", "audit_masks_missing", "disk_only_image_stems",
    "csv_only_image_stems", "csv_duplicate_stems", "disk_duplicate_image_stems", "disk_duplicate_mask_stems",
)


def column_facts(df: DataFrame, cols: Sequence[str] | None = None, exts: Iterable[str] = ALL_IMAGE_EXTS) -> DataFrame:
    """One row per column from a single pass over the table.

    Share of nulls, of file names, of parseable numbers, and whether all
    parseable numbers are 0 or 1.
    """
    exts = tuple(exts)
    cols = list(cols or df.columns)
    measures = []
    for i, c in enumerate(cols):
        col, number = F.col(f"`{c}`"), as_double(F.col(f"`{c}`"))
        present = col.isNotNull()
        measures.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(c).alias("column"),
                F.coalesce(F.avg((~present).cast("double")) * 100, F.lit(0.0)).alias("missing_pct"),
                F.coalesce(
                    F.avg(F.when(present, looks_like_filename(col.cast("string"), exts).cast("double"))), F.lit(0.0)
                ).alias("filename_share"),
                F.coalesce(F.avg(F.when(present, number.isNotNull().cast("double"))), F.lit(0.0)).alias("numeric_share"),
                ((F.count(number) > 0) & (F.count_if(~number.isin(0.0, 1.0)) == 0)).alias("binary_like"),
            ).alias(f"m{i}")
        )
    return df.agg(*measures).select(F.inline(F.array(*[f"m{i}" for i in range(len(cols))])))


def missingness(df: DataFrame, top: int = TOP_MISSING) -> DataFrame:
    """Percent of nulls per column, largest first."""
    shares = [F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns]
    long = df.agg(*shares).unpivot([], df.columns, "column", "share")
    return long.select("column", (F.col("share") * 100).alias("missing_pct")).orderBy(
        F.col("missing_pct").desc(), "column"
    ).limit(top)


def filename_scores(
    df: DataFrame, exts: Iterable[str] = ALL_IMAGE_EXTS, mask: bool = False, top: int = TOP_CANDIDATES
) -> DataFrame:
    """Columns by share of file-name-like values; mask columns get a name bonus."""
    named = F.col("column").contains("mask") | F.col("column").contains("seg")
    score = F.col("filename_share")
    if mask:
        score = F.least(F.lit(1.0), score + F.when(named, MASK_NAME_BONUS).otherwise(0.0))
    scored = column_facts(df, exts=exts).select("ordinal", "column", score.alias("score"))
    return scored.where(F.col("score") > 0).orderBy(F.col("score").desc(), "ordinal").limit(top).select("column", "score")


def binary_columns(df: DataFrame) -> DataFrame:
    return column_facts(df).select("column", "binary_like")


def numeric_columns(df: DataFrame) -> DataFrame:
    """Columns that are numeric, or whose values mostly parse as numbers."""
    typed = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    return column_facts(df).select(
        "column", (F.col("column").isin(*typed) | (F.col("numeric_share") > NUMERIC_SHARE)).alias("numeric_like")
    )


def meta_columns(df: DataFrame, label_cols: Sequence[str], file_cols: Sequence[str]) -> DataFrame:
    """The columns that are neither labels nor file names."""
    taken = {*label_cols, *file_cols}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in taken])


def infer_key_column(
    df: DataFrame,
    files: DataFrame,
    cols: Sequence[str] | None = None,
    sample_n: int | None = None,
    sample_key: str | None = None,
    seed: int = 42,
    exts: Iterable[str] = ALL_IMAGE_EXTS,
) -> DataFrame:
    """Columns by share of values whose stem is among ``files.stem``.

    All rows count unless ``sample_n`` asks for a seeded sample of rows. Values that a bit filter of the stems rules out
    go no further than the scan, so the shuffle holds possible matches, counted. Only columns with a match have their
    different values counted.
    """
    cols = list(cols or df.columns)
    if sample_n is not None:
        df = slice_ordered(df, [hash_order(seed, sample_key), F.col(sample_key)], 0, sample_n)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    known = files.select("stem").where(F.col("stem") != "")
    bits = bits_for(known.count())
    values = text.unpivot([], cols, "column", "value").withColumn("stem", norm_stem("value", exts))
    possible = keep_possible(values.select("column", "stem"), "stem", key_bits(known, "stem", bits), bits)
    # one row per column and stem, so no stem is hot
    counted = possible.groupBy("stem", "column").agg(F.count(F.lit(1)).alias("n"))
    hits = counted.join(known.distinct(), "stem", "left_semi").groupBy("column").agg(F.sum("n").alias("hits")).collect()  # a row per column
    matched = {r["column"]: r["hits"] for r in hits}
    found = [c for c in cols if c in matched]
    if not found:
        return df.sparkSession.createDataFrame([], "column string, stem_match_ratio double, nunique bigint, missing_ratio double")
    facts = [
        F.struct(
            F.lit(c).alias("column"), (F.lit(matched[c]) / F.count(f"`{c}`")).alias("stem_match_ratio"),
            (F.count_if(F.col(f"`{c}`").isNull()) / F.count(F.lit(1))).alias("missing_ratio"),
        ).alias(f"m{i}")
        for i, c in enumerate(found)
    ]
    shares = text.agg(*facts).select(F.inline(F.array(*[f"m{i}" for i in range(len(found))])))
    kept = text.select(*[F.col(f"`{c}`") for c in found]).unpivot([], found, "column", "value")
    different = kept.where(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    return (
        shares.join(different, "column")
        .select("column", "stem_match_ratio", "nunique", "missing_ratio")
        .orderBy(F.col("stem_match_ratio").desc(), "column")
    )


def best_key_column(scores: DataFrame, gate: float = KEY_MATCH_GATE) -> str:
    best = scores.first()
    if best is None or best["stem_match_ratio"] < gate:
        raise RuntimeError(f"no column matches the files well enough: {best}")
    return best["column"]


def row_sum(cols: Sequence[str]) -> Column:
    total = F.lit(0).cast("bigint")
    for c in cols:
        total = total + coerce_int0(F.col(f"`{c}`"))
    return total


def infer_label_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: shares of row sums and the label mode they imply."""
    if len(cols) < 2:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(None).cast("double").alias("ratio_eq_1"),
            F.lit(None).cast("double").alias("ratio_in_01"),
            F.lit("unknown").alias("mode"),
            F.lit(None).cast("string").alias("target_encoding"),
        )
    shares = df.select(row_sum(cols).alias("s")).agg(
        F.avg((F.col("s") == 1).cast("double")).alias("ratio_eq_1"),
        F.avg(F.col("s").isin(0, 1).cast("double")).alias("ratio_in_01"),
    )
    single = (F.col("ratio_eq_1") >= ONE_HOT_SHARE) & (F.col("ratio_in_01") >= ZERO_ONE_SHARE)
    return shares.withColumn("mode", F.when(single, "single_label").otherwise("multi_label")).withColumn(
        "target_encoding", F.when(single, "one_hot_multiclass").otherwise("multi_label_binary_cols")
    )


def one_hot_sanity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per row sum, with the share of rows whose sum is not 1."""
    sums = df.groupBy(row_sum(cols).alias("row_sum")).agg(F.count(F.lit(1)).alias("rows"))
    bad = sums.agg(
        F.coalesce(F.sum(F.when(F.col("row_sum") != 1, F.col("rows"))), F.lit(0)) * 100 / F.sum("rows")
    ).scalar()
    return sums.withColumn("invalid_pct", bad).orderBy(F.col("rows").desc(), "row_sum")


def class_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column sums of one-hot columns, largest first."""
    sums = df.agg(*[F.sum(coerce_int0(F.col(f"`{c}`"))).alias(c) for c in cols])
    return sums.unpivot([], list(cols), "label", "count").orderBy(F.col("count").desc(), "label")


def positive_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows equal to 1 per label column, largest first."""
    hits = df.agg(*[F.count_if(as_double(F.col(f"`{c}`")) == 1.0).alias(c) for c in cols])
    return hits.unpivot([], list(cols), "label", "positives").orderBy(F.col("positives").desc(), "label")


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per column."""
    numbers = df.select(*[as_number(df, c).alias(c) for c in cols])
    # one row of structs: no row is multiplied by the number of columns
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        ).alias(f"m{i}")
        for i, c in enumerate(cols)
    ]
    basics = numbers.agg(*facts).select(F.inline_outer(F.array(*[f"m{i}" for i in range(len(cols))])))
    quartiles = exact_quantiles(numbers, cols, {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4)})
    return basics.join(quartiles, "column", "left")


def as_number(df: DataFrame, c: str) -> Column:
    return as_double(F.col(f"`{c}`")) if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`").cast("double")


def value_counts(df: DataFrame, col: str, top: int = TOP_VALUES, null_as: str = "nan") -> DataFrame:
    """The most frequent values, null counted as a value."""
    return (
        df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(null_as)).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "value")
        .limit(top)
    )


def duplicates(df: DataFrame, key: str | Column) -> DataFrame:
    """One row: rows in duplicate groups, and duplicate groups. An empty key is a value."""
    return (
        df.groupBy((key if isinstance(key, Column) else F.col(key)).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"),
            F.count(F.lit(1)).alias("groups"),
        )
    )


def duplicate_sample(df: DataFrame, keys: dict[str, Column], top: int = TOP_DUPLICATES) -> DataFrame:
    """The smallest repeated values of several keys, with their rows: ``key, value, rows``.

    Values are counted map-side, and each task passes on its ``top`` smallest repeated ones of a key only: the sample is
    merged, not gathered. Null is no value; an empty text is one.
    """
    named = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in keys.items()]
    long = df.select(F.explode_outer(F.array(*named)).alias("r")).select("r.*").where(F.col("value").isNotNull())
    counted = long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return _smallest(counted, top)


def _smallest(counted: DataFrame, top: int) -> DataFrame:
    """The ``top`` smallest values per key. A rank with a limit is cut before the shuffle, too."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("value"))
    return counted.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def stem_facts(audited: DataFrame, images: DataFrame, masks: DataFrame | None = None, exts: Iterable[str] = ALL_IMAGE_EXTS) -> DataFrame:
    """One row per stem and side: ``stem, n_rows, n_no_image, n_no_mask, n_images, n_masks``; sides that lack it say 0.

    Each table is counted by stem before they meet, so a stem that holds much of the data is one row a task.
    """
    sides = [
        audited.groupBy(F.col("image_stem").alias("stem")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~F.col("image_exists")).alias("n_no_image"),
            F.count_if(~F.col("mask_exists")).alias("n_no_mask"),
        ),
        key_counts(images.select(norm_stem("path", exts).alias("stem")), ["stem"], "n_images"),
    ]
    if masks is not None:
        sides.append(key_counts(masks.select(norm_stem("path", exts).alias("stem")), ["stem"], "n_masks"))
    counts = ("n_rows", "n_no_image", "n_no_mask", "n_images", "n_masks")
    # the sides are counted, so their rows can simply be put under each other and added up
    filled = [d.select("stem", *[(F.col(c) if c in d.columns else F.lit(0).cast("bigint")).alias(c) for c in counts]) for d in sides]
    return reduce(DataFrame.unionByName, filled).groupBy("stem").agg(*[F.sum(c).alias(c) for c in counts])


def one_sided(stems: DataFrame, top: int = TOP_DUPLICATES) -> DataFrame:
    """Samples of the report, ``key, value, rows``: stems of one side only, and repeated ones of each side."""
    named = F.col("stem") != ""
    tests = {
        "csv_only": (named & (F.col("n_rows") > 0) & (F.col("n_images") == 0), "n_rows"),
        "disk_only": (named & (F.col("n_rows") == 0) & (F.col("n_images") > 0), "n_images"),
        "csv_duplicate": (F.col("n_rows") > 1, "n_rows"),
        "disk_duplicate_image": (F.col("n_images") > 1, "n_images"),
        "disk_duplicate_mask": (F.col("n_masks") > 1, "n_masks"),
    }
    entries = [
        F.when(test, F.struct(F.lit(k).alias("key"), F.col("stem").alias("value"), F.col(n).alias("rows")))
        for k, (test, n) in tests.items()
    ]
    return _smallest(stems.select(F.inline(F.array_compact(F.array(*entries)))), top)


def audit_totals(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("image_exists")).alias("images_missing"),
        F.count_if(~F.col("mask_exists")).alias("masks_missing"),
        F.count_if(F.col("issues") != "").alias("rows_with_issues"),
    )


def side_totals(stems: DataFrame, with_masks: bool = True) -> DataFrame:
    """One row of totals over :func:`stem_facts`. Without a mask table no mask counts as missing."""
    named = F.col("stem") != ""

    def total(count: str, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(count if where is None else F.when(where, F.col(count))), F.lit(0))

    return stems.agg(
        total("n_rows").alias("audit_total_rows"),
        total("n_no_image").alias("audit_images_missing"),
        (total("n_no_mask") if with_masks else F.lit(0).cast("bigint")).alias("audit_masks_missing"),
        F.count_if(named & (F.col("n_rows") == 0) & (F.col("n_images") > 0)).alias("disk_only_image_stems"),
        F.count_if(named & (F.col("n_rows") > 0) & (F.col("n_images") == 0)).alias("csv_only_image_stems"),
        F.count_if(F.col("n_rows") > 1).alias("csv_duplicate_stems"),
        total("n_rows", F.col("n_rows") > 1).alias("csv_duplicate_rows"),
        F.count_if(F.col("n_images") > 1).alias("disk_duplicate_image_stems"),
        F.count_if(F.col("n_masks") > 1).alias("disk_duplicate_mask_stems"),
        total("n_images").alias("image_files_on_disk"),
        total("n_masks").alias("mask_files_on_disk"),
    )


def full_summary(
    audited: DataFrame,
    images: DataFrame,
    masks: DataFrame | None,
    schema: DataFrame,
    places: dict[str, str],
    columns: Sequence[str],
    exts: Iterable[str] = ALL_IMAGE_EXTS,
) -> DataFrame:
    """The summary's 23 keys as ``(key, value)`` in their order.

    ``schema`` is the row of :func:`tallyframe.operators.schema.infer_schema`, ``places`` the run's time and folders,
    ``columns`` the manifest's columns. A place that is not given, and a role no column has, is ``None``.
    """
    totals = side_totals(stem_facts(audited, images, masks, exts), masks is not None)
    # both hold one row
    both = totals.withColumn("_schema", schema.select(F.struct(*schema.columns)).scalar())
    role = F.col("_schema")
    known = {
        **{k: F.lit(places.get(k)) for k in PLACES},
        "csv_rows": F.col("audit_total_rows"),
        "csv_cols": F.lit(len(columns)),
        "image_col_inferred": role["image_col"],
        "mask_col_inferred": role["mask_col"],
        "mode_inferred": role["mode"],
        "target_encoding": role["target_encoding"],
        "label_cols_count": F.size(role["label_cols"]),
        "meta_cols_count": F.size(role["meta_cols"]),
    }
    return key_value(both.select(*[known.get(k, F.col(k)).alias(k) for k in SUMMARY_KEYS]))


def key_value(row: DataFrame) -> DataFrame:
    """A one-row frame as ``(key, value)`` text."""
    text = row.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")).alias(c) for c in row.columns])
    return text.unpivot([], row.columns, "key", "value")


def audit_summary(
    audited: DataFrame, images: DataFrame, masks: DataFrame, facts: dict[str, str | int | None] | None = None
) -> DataFrame:
    """The audit's key/value summary; ``facts`` adds values known before the run."""
    rows = audited.groupBy("image_stem").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(~F.col("image_exists")).alias("_no_image"),
        F.count_if(~F.col("mask_exists")).alias("_no_mask"),
    )
    on_disk = key_counts(images.select(norm_stem("path").alias("image_stem")), ["image_stem"], "_files")
    masks_on_disk = key_counts(masks.select(norm_stem("path").alias("stem")), ["stem"], "_files").agg(
        F.struct(F.coalesce(F.sum("_files"), F.lit(0)).alias("files"), F.count_if(F.col("_files") > 1).alias("repeated")).alias("m")
    )
    named = F.col("image_stem") != ""
    zero = F.lit(0)
    # audited rows and files meet once, counted per stem
    totals = (
        rows.join(on_disk, "image_stem", "full_outer")
        .agg(
            F.coalesce(F.sum("_rows"), zero).alias("audit_total_rows"),
            F.coalesce(F.sum("_no_image"), zero).alias("audit_images_missing"),
            F.coalesce(F.sum("_no_mask"), zero).alias("audit_masks_missing"),
            F.coalesce(F.sum("_files"), zero).alias("image_files_on_disk"),
            F.count_if(F.col("_rows").isNull() & named).alias("disk_only_image_stems"),
            F.count_if(F.col("_files").isNull() & named).alias("csv_only_image_stems"),
            F.count_if(F.col("_rows") > 1).alias("csv_duplicate_stems"),
            F.count_if(F.col("_files") > 1).alias("disk_duplicate_image_stems"),
        )
        .withColumn("_masks", masks_on_disk.scalar())
        .withColumn("mask_files_on_disk", F.col("_masks.files"))
        .withColumn("disk_duplicate_mask_stems", F.col("_masks.repeated"))
        .drop("_masks")
        .withColumns({k: F.lit(v).cast("string") for k, v in (facts or {}).items()})
    )
    return key_value(totals)
