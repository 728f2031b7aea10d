"""Manifest rows against files: cascades, audit, differences, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.names import (
    ALL_IMAGE_EXTS,
    CANDIDATE_SUFFIXES,
    PROJECT_IMAGE_EXTS,
    base_name,
    drop_suffix,
    file_suffix,
    mask_aliases,
    norm_stem,
    relative_to,
    slashes,
    strip_quotes,
)
from tallyframe.functions.values import issue_codes, safe_str
from tallyframe.plans import skew
from tallyframe.plans.skew import key_counts, salted_join

def file_keys(files: DataFrame, kinds: Iterable[str] = ("path", "stem"), exts: Sequence[str] = ALL_IMAGE_EXTS) -> DataFrame:
    """``(key, found)``: the smallest rank and path under each lookup key.

    Files say what they can be found by, so that a row has to ask little: ``path`` keys are whole paths, ``stem`` keys
    lower-case stems, ``base`` keys paths without one of ``exts`` (ranked by these), ``mask`` keys stems as they are and
    without each mask suffix they end with (ranked by these), ``prefix`` keys a folder plus the name up to each dot.
    """
    made = {
        "path": F.array(_entry(0, F.concat(F.lit("path:"), "path"))),
        "stem": F.array(_entry(0, F.concat(F.lit("stem:"), norm_stem("path")))),
        "base": _bases(exts),
        "mask": _mask_stems(),
        "prefix": F.transform(_dot_prefixes(), lambda k: _entry(0, k)),
    }
    entries = F.filter(F.concat(*[made[k] for k in kinds]), lambda e: e["key"].isNotNull())
    keyed = files.select("path", F.inline(entries))
    return keyed.groupBy("key").agg(F.min(F.struct("rank", "path")).alias("found"))


def _entry(rank: int | Column, key: Column) -> Column:
    return F.struct((rank if isinstance(rank, Column) else F.lit(rank)).alias("rank"), key.alias("key"))


def _without(text: Column, ending: Column) -> Column:
    """The text without its ending; null where it ends otherwise or nothing is left."""
    rest = F.substring(text, F.lit(1), F.length(text) - F.length(ending))
    return F.when(F.endswith(text, ending), F.nullif(rest, F.lit("")))


def _bases(exts: Sequence[str]) -> Column:
    endings = F.array(*[F.lit("." + e) for e in exts])
    return F.transform(endings, lambda e, i: _entry(i, F.concat(F.lit("base:"), _without(F.col("path"), e))))


def _mask_stems() -> Column:
    suffixes = F.array(*[F.lit(x) for x in CANDIDATE_SUFFIXES])
    return F.transform(suffixes, lambda x, i: _entry(i, F.concat(F.lit("mask:"), _without(norm_stem("path"), x))))


def _dot_prefixes() -> Column:
    folder = F.regexp_replace(F.col("path"), "[^/]*$", "")
    parts = F.split(base_name("path"), r"\.")
    upto = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.concat(F.lit("prefix:"), folder, F.array_join(F.slice(parts, 1, n), ".")),
    )
    return F.when(F.size(parts) > 1, upto).otherwise(F.array().cast("array<string>"))


def attach_best(
    df: DataFrame,
    by: Sequence[str],
    with_options: Callable[[DataFrame], DataFrame],
    keys: DataFrame,
    out: str,
    spread_by: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """Adds the path of the first candidate that exists; ``with_options`` adds the candidates as ``options``."""
    return attach_each(df, by, with_options, {out: ("options", keys)}, spread_by, rows)


def attach_each(
    df: DataFrame,
    by: Sequence[str],
    with_options: Callable[[DataFrame], DataFrame],
    sides: dict[str, tuple[str, DataFrame]],
    spread_by: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """Adds, per output column, the path of the first candidate that exists.

    ``with_options`` adds candidates (arrays of priority and key) to the
    distinct values; ``sides`` names their column and the file keys of each output. All of them meet the
    files in one join; the result, one row per
    value, goes back to the rows by a join that spreads hot values.
    """
    rows = df.count() if rows is None else rows
    asked = with_options(df.select(*by).distinct())
    marked = [_marked(options, i) for i, (options, _) in enumerate(sides.values())]
    # the outer form keeps the optimizer from testing the size of the options at the scan, which
    # would build them once more for every row
    options = asked.select(*by, F.inline_outer(F.concat(*marked))).where(F.col("key").isNotNull())
    keyed = [keys.select(F.lit(i).alias("side"), "key", "found") for i, (_, keys) in enumerate(sides.values())]
    # distinct values are no more than the rows, so few rows mean no hot key here either
    found = salted_join(
        options, reduce(DataFrame.unionByName, keyed), ["side", "key"], "inner", by, rows=None if rows >= skew.HOT_MIN_ROWS else rows
    )
    place = F.struct((F.col("prio") + F.col("found.rank")).alias("prio"), F.col("found.path").alias("path"))
    best = found.groupBy(*by).agg(*[F.min(F.when(F.col("side") == i, place)).alias(f"_best{i}") for i in range(len(sides))])
    best = best.select(*by, *[F.col(f"_best{i}.path").alias(out) for i, out in enumerate(sides)])
    return salted_join(df, best, by, "left", spread_by, rows=rows)


def _option(prio: int | Column, key: Column) -> Column:
    prio = prio if isinstance(prio, Column) else F.lit(prio)
    return F.struct(prio.alias("prio"), key.alias("key"))


def _marked(options: str, side: int) -> Column:
    return F.transform(options, lambda o: F.struct(F.lit(side).alias("side"), o["prio"].alias("prio"), o["key"].alias("key")))


def _joined(folder: str, name: Column) -> Column:
    prefix = folder.rstrip("/") + "/" if folder else ""
    return F.concat(F.lit("path:" + prefix), name)


def image_options(
    asked: DataFrame,
    value: str,
    strategy: str,
    images_dir: str,
    root: str,
    exts: Sequence[str] | None = None,
    out: str = "options",
) -> DataFrame:
    """Adds the lookup keys of an image value in order of preference; unfit ones are null.

    ``stem``: whole path, file name in the folder, then lower-case stem.
    ``project``: whole path, below the root, file name, stem with each extension.
    ``glob``: whole path or below the root, file name, below the folder, stem
    with each extension, any file that starts with the stem and a dot.
    """
    # path, name and stem are made once per value and then only concatenated
    clean = strip_quotes(value) if strategy == "project" else F.trim(F.col(value))
    parts = asked.withColumn("_path", slashes(clean)).withColumn("_name", F.substring_index("_path", "/", -1))
    path, name = F.nullif(F.col("_path"), F.lit("")), F.nullif(F.col("_name"), F.lit(""))
    absolute = path.rlike("^(/|[A-Za-z]:/|[a-z0-9]+:/)")
    whole = F.concat(F.lit("path:"), path)
    if strategy == "stem":
        known = file_suffix("_name").isin(*(exts or ALL_IMAGE_EXTS))
        parts = parts.withColumn("_stem", F.nullif(norm_stem("_path", exts or ALL_IMAGE_EXTS), F.lit("")))
        parts = parts.withColumn("_known", known)
        tries = [
            F.when(absolute & F.col("_known"), whole),
            F.when(F.col("_known"), _joined(images_dir, name)),
            F.concat(F.lit("stem:"), "_stem"),
        ]
        options = F.array(*[_option(i, t) for i, t in enumerate(tries)])
    elif strategy in ("project", "glob"):
        parts = parts.withColumn("_stem", drop_suffix(name)).withColumn("_absolute", absolute)
        tries = [
            F.when(F.col("_absolute"), whole),
            F.when(~F.col("_absolute"), _joined(root, path)),
            _joined(images_dir, name),
        ]
        last = []
        below = F.lit(images_dir.rstrip("/") + "/" if images_dir else "")
        if strategy == "glob":
            tries.append(F.when(~F.col("_absolute") & (path != name), _joined(images_dir, path)))
            last = [_option(100, F.concat(F.lit("prefix:" + images_dir.rstrip("/") + "/"), "_stem"))]
        # files give their path without the extension, ranked by it
        tries.append(F.concat(F.lit("base:"), below, "_stem"))
        options = F.array(*[_option(i, t) for i, t in enumerate(tries)], *last)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return parts.withColumn(out, options).drop("_path", "_name", "_stem", "_known", "_absolute")


def lookup_keys(files: DataFrame, strategy: str, exts: Sequence[str] | None = None) -> DataFrame:
    """The file keys that a strategy of :func:`image_options` asks for."""
    kinds = {"stem": ("path", "stem"), "project": ("path", "base"), "glob": ("path", "base", "prefix")}[strategy]
    return file_keys(files, kinds, exts or (PROJECT_IMAGE_EXTS if strategy == "project" else ALL_IMAGE_EXTS))


def mask_options(asked: DataFrame, stem: str, start: int = 0, out: str = "options") -> DataFrame:
    """Adds the lookup keys of a mask for an image stem.

    One key for the stem with every suffix, as files give their stems without it, and one for each suffix that the
    stem itself ends with.
    """
    s = F.nullif(F.lower(F.trim(F.col(stem))), F.lit(""))
    suffixes = F.array(*[F.lit(x) for x in CANDIDATE_SUFFIXES])
    cut = F.transform(
        suffixes, lambda x, i: _option(i + start + 100, F.concat(F.lit("stem:"), F.when(x != "", _without(s, x))))
    )
    own = F.array(_option(start, F.concat(F.lit("mask:"), s)))
    return asked.withColumn(out, F.filter(F.concat(own, cut), lambda o: o["key"].isNotNull()))


def resolve_images(
    manifest: DataFrame,
    files: DataFrame,
    value: str,
    spread_by: Sequence[str],
    strategy: str = "stem",
    images_dir: str = "images",
    root: str = "",
    exts: Sequence[str] | None = None,
    out: str = "resolved_path",
) -> DataFrame:
    asked = manifest.withColumn(value, safe_str(value))

    def options(values: DataFrame) -> DataFrame:
        return image_options(values, value, strategy, images_dir, root, exts)

    return attach_best(asked, [value], options, lookup_keys(files, strategy, exts), out, spread_by)


def resolve_masks(
    stems: DataFrame, masks: DataFrame, stem: str, spread_by: Sequence[str], out: str = "mask_path"
) -> DataFrame:
    """Mask per stem: the stem itself, with a suffix added, with one removed."""
    asked = stems.withColumn(stem, safe_str(stem))
    return attach_best(asked, [stem], lambda d: mask_options(d, stem), file_keys(masks, ("stem", "mask")), out, spread_by)


def audit(
    manifest: DataFrame,
    images: DataFrame,
    masks: DataFrame | None,
    image_col: str,
    row_idx: str,
    mask_col: str | None = None,
    images_dir: str = "images",
    masks_dir: str = "masks",
    root: str = "",
    exts: Sequence[str] | None = None,
) -> DataFrame:
    """One row per manifest row: what it names, what was found, what is wrong."""
    exts = tuple(exts or ALL_IMAGE_EXTS)
    n_rows = manifest.count()
    rows = manifest.select(
        F.col(row_idx).alias("row_idx"),
        F.lit(image_col).alias("image_col_used"),
        safe_str(image_col).alias("csv_image_value"),
        norm_stem(safe_str(image_col), exts).alias("image_stem"),
        F.lit(mask_col or "").alias("mask_col_used"),
        (safe_str(mask_col) if mask_col else F.lit("")).alias("csv_mask_value"),
    )
    sides = {"_image": ("_by_value", file_keys(images))}
    rules = [
        (F.col("csv_image_value") == "", "CSV_IMAGE_VALUE_EMPTY"),
        (F.col("_image").isNull(), "IMAGE_NOT_FOUND_ON_DISK"),
    ]
    if masks is not None:
        sides["_mask"] = ("_by_mask", file_keys(masks, ("path", "stem", "mask")))
        rules.append((F.col("_mask").isNull(), "MASK_NOT_FOUND_ON_DISK"))
    named = file_suffix("csv_mask_value").isin(*exts)

    def options(values: DataFrame) -> DataFrame:
        both = image_options(values, "csv_image_value", "stem", images_dir, root, exts, out="_by_value")
        if masks is None:
            return both
        if mask_col is None:
            return mask_options(both, "image_stem", start=10, out="_by_mask")
        both = mask_options(both, "image_stem", start=10, out="_by_stem")
        both = image_options(both, "csv_mask_value", "stem", masks_dir, root, exts, out="_named")
        return both.withColumn("_by_mask", F.when(named, F.concat("_named", "_by_stem")).otherwise(F.col("_by_stem")))

    # images and masks of a row's values are looked up together; the stem follows from the image value
    by = ["csv_image_value", "image_stem", *(["csv_mask_value"] if mask_col else [])]
    rows = attach_each(rows, by, options, sides, ["row_idx"], n_rows)
    if masks is None:
        rows = rows.withColumn("_mask", F.lit(None).cast("string"))
    return rows.select(
        "row_idx",
        "image_col_used",
        "csv_image_value",
        "image_stem",
        safe_str(relative_to("_image", root) if root else "_image").alias("resolved_image_rel"),
        F.col("_image").isNotNull().alias("image_exists"),
        "mask_col_used",
        "csv_mask_value",
        safe_str(relative_to("_mask", root) if root else "_mask").alias("resolved_mask_rel"),
        F.col("_mask").isNotNull().alias("mask_exists"),
        issue_codes(*rules).alias("issues"),
    )


def valid_items(audited: DataFrame) -> DataFrame:
    """Rows with an image, those with a mask first."""
    return audited.where("image_exists").orderBy(F.col("mask_exists").desc(), "row_idx")


def clean_dataset(audited: DataFrame) -> DataFrame:
    """One row per resolved image stem: rows without an image go, the smallest row index stays."""
    first = F.min(F.struct("row_idx", "resolved_image_rel", "mask_exists")).alias("r")
    return (
        audited.where(F.col("image_exists") & (F.col("image_stem") != ""))
        .groupBy("image_stem")
        .agg(first)
        .select("image_stem", "r.row_idx", F.col("r.resolved_image_rel").alias("image_path"), "r.mask_exists")
    )


def images_by_id(files: DataFrame) -> DataFrame:
    """Image per id; the last by lower-case name wins."""
    return files.groupBy(F.col("stem").alias("id")).agg(
        F.max_by(F.struct("path", "name"), F.struct(F.lower("name"), "path")).alias("f")
    ).select("id", F.col("f.path").alias("image_path"), F.col("f.name").alias("image_filename"))


def masks_by_alias(masks: DataFrame) -> DataFrame:
    """Mask per alias; the first by lower-case name wins."""
    return (
        masks.select(F.explode_outer(mask_aliases("stem")).alias("id"), "path", "name")
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min_by(F.struct("path", "name"), F.struct(F.lower("name"), "path")).alias("f"))
        .select("id", F.col("f.path").alias("mask_path"), F.col("f.name").alias("mask_filename"))
    )


def attach_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with their masks; both sides hold one row per id."""
    return images.join(masks_by_alias(masks), "id", "left")


def with_exists(df: DataFrame, keys: DataFrame, key: str, spread_by: Sequence[str], out: str) -> DataFrame:
    """Whether the key of each row is among ``keys``."""
    known = keys.select(key).distinct().withColumn(out, F.lit(True))
    joined = salted_join(df, known, [key], "left", spread_by)
    return joined.withColumn(out, F.coalesce(out, F.lit(False)))


def files_only(files: DataFrame, manifest: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Rows of the first frame whose key the second lacks."""
    return salted_join(files, manifest.select(key).distinct(), [key], "left_anti", spread_by)


def manifest_only(manifest: DataFrame, files: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    return files_only(manifest, files, key, spread_by)


def diff_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side, sorted. Sides are made distinct before they meet."""
    left = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_b").isNull(), "left_only").otherwise("right_only")
    return (
        left.join(right, key, "full_outer")
        .where(F.col("_a").isNull() | F.col("_b").isNull())
        .select(side.alias("side"), key)
        .orderBy("side", key)
    )


def stem_index(files: DataFrame, exts: Sequence[str] = ALL_IMAGE_EXTS, spread_by: Sequence[str] = ("path",)) -> DataFrame:
    """The stem index, one row per file: group size and the path lookups pick.

    Paths of a stem stay rows; gathering them in one value would put a stem
    that names much of the data into one task.
    """
    stemmed = files.withColumn("stem", norm_stem("path", exts))
    facts = stemmed.groupBy("stem").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"))
    counts = facts.select("stem", F.col("n_paths").alias("n"))
    return salted_join(stemmed.select("stem", "path"), facts, ["stem"], "left", spread_by, counts=counts)


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The smallest row of each key by ``order``; combined map-side, so no key is gathered."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The largest row of each key by ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def flag_duplicates(df: DataFrame, key: str, spread_by: Sequence[str], out: str = "duplicate") -> DataFrame:
    """Marks every row whose key occurs again.

    Counts are combined map-side and only repeated keys come back, through a
    join that spreads hot keys.
    """
    counts = key_counts(df, [key])
    repeated = counts.where(F.col("n") > 1).select(key, F.lit(True).alias(out))
    return salted_join(df, repeated, [key], "left", spread_by, counts=counts).withColumn(out, F.coalesce(out, F.lit(False)))


def text_key(text: str) -> Column:
    """A fixed-width key of a whole text, so that long texts are not shuffled."""
    return F.sha2(F.col(text), 256)


def check_paths(df: DataFrame, files: DataFrame, key: str, order: Sequence[str], sample: int = 250, show: int = 8) -> DataFrame:
    """Among the first rows, examples of keys that no file has. Both limits are the report's own."""
    head = df.orderBy(*order).limit(sample)
    return head.join(files.select(key).distinct(), key, "left_anti").orderBy(*order).limit(show)
