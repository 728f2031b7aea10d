"""The dataset as items: summary, pages, search, detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.values import CLASS_NAMES, pretty_label
from tallyframe.operators.resolve import attach_masks, masks_by_alias
from tallyframe.plans.pages import page_by_keys
from tallyframe.sources.history import check_page


def summary(images: DataFrame, masks: DataFrame, records: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: image ids, mask files in use, manifest records, and the manifest's columns when given."""
    used = masks_by_alias(masks).agg(F.countDistinct("mask_path")).scalar()
    ids = images.agg(F.countDistinct("stem")).scalar()
    header = [] if columns is None else [F.array(*[F.lit(c) for c in columns]).alias("columns")]
    return records.agg(F.count(F.lit(1)).alias("csv_rows")).select(
        ids.alias("num_images"), used.alias("num_masks"), "csv_rows", *header
    )


def search(df: DataFrame, query: str, key: str = "id") -> DataFrame:
    """Rows whose id contains the text, letter case ignored."""
    wanted = (query or "").strip().lower()
    return df.where(F.lower(key).contains(wanted)) if wanted else df


def sort_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(F.lower(key), key)


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, limit: int, offset: int, key: str = "id", max_limit: int = 200) -> DataFrame:
    """A page in id order, with the total and whether more rows follow."""
    check_page(limit, offset, max_limit)
    total = total_rows(df).scalar()
    rows = page_by_keys(df, [(F.lower(key), True), (key, True)], offset, limit)
    return rows.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def list_items(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``(id, has_mask)`` per image id. ``images`` holds one row per id."""
    return attach_masks(images.select("id"), masks).select("id", F.col("mask_path").isNotNull().alias("has_mask"))


def with_meta(items: DataFrame, index: DataFrame) -> DataFrame:
    """Items with their manifest map, empty when the manifest lacks the id."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return items.join(index, "id", "left").withColumn("meta", F.coalesce("meta", none))


def with_targets(items: DataFrame, label_cols: list[str] | None = None) -> DataFrame:
    """Adds the positive classes of each item's map, in column order."""
    entry_on = F.filter(F.map_entries("meta"), lambda e: e["value"].try_cast("double") == 1.0)
    names = F.transform(entry_on, lambda e: e["key"])
    if label_cols is not None:
        names = F.filter(names, lambda n: n.isin(*label_cols))
    return (
        items.withColumn("positive_classes", names)
        .withColumn("target", F.array_join("positive_classes", "|"))
        .withColumn("target_pretty", pretty_label("target", CLASS_NAMES))
    )


def item_detail(images: DataFrame, masks: DataFrame, index: DataFrame) -> DataFrame:
    """Image, mask and manifest facts per item."""
    found = attach_masks(images, masks).withColumn("has_mask", F.col("mask_path").isNotNull())
    return with_targets(with_meta(found, index))


def get_item(images: DataFrame, masks: DataFrame, index: DataFrame, item_id: str) -> DataFrame:
    """Zero or one item; the id filter is applied to every input first."""
    mine = F.col("id") == item_id
    found = images.where(mine).join(masks_by_alias(masks).where(mine), "id", "left")
    return with_targets(
        with_meta(found.withColumn("has_mask", F.col("mask_path").isNotNull()), index.where(mine))
    )
