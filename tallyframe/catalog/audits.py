"""Audit queries over manifests with repeated and empty names, and files without rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import views as v
from tallyframe.catalog.registry import query
from tallyframe.catalog.tables import MODE_SQL, r6
from tallyframe.functions.names import norm_stem
from tallyframe.operators import profile, resolve, schema

LABELS = ["en", "de", "fr", "es"]
PLACES = {"project_root": "data", "groundtruth_csv": "data/truth.csv", "images_dir": "img", "masks_dir": "msk"}

# every seventh row repeats the name of the one before, every eleventh has none
V_REPEATS = """repeats AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'data/Doc_' || k || '.jpg' END AS image,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'doc_' || k END AS stem,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'doc_' || k || '_seg.png' END AS seg_name, n_chars,
    CAST(lang = 'en' AS INT) AS en, CAST(lang = 'de' AS INT) AS de, CAST(lang = 'fr' AS INT) AS fr, CAST(lang = 'es' AS INT) AS es, k
  FROM (SELECT *, doc_id - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS k FROM documents)),
image_files AS (SELECT 'doc_' || doc_id AS stem FROM labels UNION ALL SELECT 'doc_' || doc_id FROM labels WHERE toxic = 1
  UNION ALL SELECT 'extra_' || doc_id FROM labels WHERE quality = 0),
mask_files AS (SELECT 'doc_' || doc_id || '_segmentation' AS stem FROM labels WHERE quality = 1
  UNION ALL SELECT 'doc_' || doc_id || '_segmentation' FROM labels WHERE toxic = 1),
checked AS (SELECT *, stem IN (SELECT stem FROM image_files) AS image_exists,
  stem <> '' AND stem || '_segmentation' IN (SELECT stem FROM mask_files) AS mask_exists FROM repeats),
sides AS (SELECT stem, sum(a)::BIGINT AS n_rows, sum(b)::BIGINT AS n_images, sum(c)::BIGINT AS n_masks FROM (
  SELECT stem, 1 AS a, 0 AS b, 0 AS c FROM checked UNION ALL SELECT stem, 0, 1, 0 FROM image_files
  UNION ALL SELECT stem, 0, 0, 1 FROM mask_files) GROUP BY stem)"""

TOTALS = {
    "audit_total_rows": "(SELECT count(*) FROM checked)",
    "audit_images_missing": "(SELECT count(*) FROM checked WHERE NOT image_exists)",
    "audit_masks_missing": "(SELECT count(*) FROM checked WHERE NOT mask_exists)",
    "disk_only_image_stems": "(SELECT count(*) FROM sides WHERE n_rows = 0 AND n_images > 0)",
    "csv_only_image_stems": "(SELECT count(*) FROM sides WHERE n_rows > 0 AND n_images = 0 AND stem <> '')",
    "csv_duplicate_stems": "(SELECT count(*) FROM sides WHERE n_rows > 1)",
    "csv_duplicate_rows": "(SELECT coalesce(sum(n_rows), 0)::BIGINT FROM sides WHERE n_rows > 1)",
    "disk_duplicate_image_stems": "(SELECT count(*) FROM sides WHERE n_images > 1)",
    "disk_duplicate_mask_stems": "(SELECT count(*) FROM sides WHERE n_masks > 1)",
    "image_files_on_disk": "(SELECT count(*) FROM image_files)",
    "mask_files_on_disk": "(SELECT count(*) FROM mask_files)",
}


def repeats(spark, folder):
    docs = v.table(spark, folder, "documents")
    k = (F.col("doc_id") - F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("string")
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("data/Doc_"), k, F.lit(".jpg"))).alias("image"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("doc_"), k, F.lit("_seg.png"))).alias("seg_name"),
        "n_chars",
        *[(F.col("lang") == c).cast("int").alias(c) for c in LABELS],
    )


def _paths(labels, where, prefix, suffix):
    return labels.where(where).select(F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"))


def image_files(spark, folder):
    labels = v.table(spark, folder, "labels")
    found = _paths(labels, F.lit(True), "img/doc_", ".JPG").unionByName(_paths(labels, "toxic = 1", "img/sub/doc_", ".png"))
    return found.unionByName(_paths(labels, "quality = 0", "img/extra_", ".jpg"))


def mask_files(spark, folder):
    labels = v.table(spark, folder, "labels")
    found = _paths(labels, "quality = 1", "msk/doc_", "_segmentation.png")
    return found.unionByName(_paths(labels, "toxic = 1", "msk/sub/doc_", "_segmentation.png"))


def checked(spark, folder):
    return resolve.audit(
        repeats(spark, folder), image_files(spark, folder), mask_files(spark, folder),
        image_col="image", row_idx="doc_id", images_dir="img", masks_dir="msk",
    )


def stems(spark, folder):
    return profile.stem_facts(checked(spark, folder), image_files(spark, folder), mask_files(spark, folder))


def inferred(spark, folder):
    files = image_files(spark, folder).select(norm_stem("path").alias("stem"))
    return schema.infer_schema(repeats(spark, folder), files, ["image", "seg_name", "n_chars", *LABELS])


@query("a13_side_totals", f"WITH {V_REPEATS} SELECT " + ", ".join(f"{sql} AS {k}" for k, sql in TOTALS.items()))
def a13_sides(spark, folder):
    return profile.side_totals(stems(spark, folder))


SAMPLES = {
    "csv_only": ("n_rows > 0 AND n_images = 0 AND stem <> ''", "n_rows"),
    "disk_only": ("n_rows = 0 AND n_images > 0", "n_images"),
    "csv_duplicate": ("n_rows > 1", "n_rows"),
    "disk_duplicate_image": ("n_images > 1", "n_images"),
    "disk_duplicate_mask": ("n_masks > 1", "n_masks"),
}


@query(
    "a12_side_samples",
    f"WITH {V_REPEATS} " + " UNION ALL ".join(
        f"(SELECT '{k}' AS key, stem AS value, {n} AS rows FROM sides WHERE {test} ORDER BY stem LIMIT 10)" for k, (test, n) in SAMPLES.items()
    ),
)
def a12_sides(spark, folder):
    return profile.one_sided(stems(spark, folder))


@query(
    "a12_duplicate_sample",
    """(SELECT 'text' AS key, sha256(text) AS value, count(*) AS rows FROM documents GROUP BY 2 HAVING count(*) > 1 ORDER BY value LIMIT 10)
       UNION ALL (SELECT 'source', source, count(*) FROM documents GROUP BY 2 HAVING count(*) > 1 ORDER BY source LIMIT 10)
       UNION ALL (SELECT 'size', CAST(n_chars AS VARCHAR), count(*) FROM documents GROUP BY 2 HAVING count(*) > 1
         ORDER BY CAST(n_chars AS VARCHAR) LIMIT 10)""",
)
def a12_sample(spark, folder):
    keys = {"text": resolve.text_key("text"), "source": F.col("source"), "size": F.col("n_chars")}
    return profile.duplicate_sample(v.table(spark, folder, "documents"), keys)


ONE_HOT_MODE = MODE_SQL.format("onehot", "(en + de + fr + es)", "repeats")


@query(
    "a3_a6_inferred_schema",
    f"""WITH {V_REPEATS}, m AS ({ONE_HOT_MODE}) SELECT 'image' AS image_col, 'image' AS image_col_by_name, 'seg_name' AS mask_col,
        'en,de,fr,es' AS label_cols, 'n_chars' AS meta_cols, mode, target_encoding, 4 AS binary_cols_count,
        (SELECT round(avg(CASE WHEN image_exists THEN 1.0 ELSE 0 END), 6) FROM checked) AS image_col_match,
        (SELECT round(avg(CASE WHEN image <> '' THEN 1.0 ELSE 0 END), 6) FROM checked) AS image_score,
        (SELECT round(least(1.0, 0.15 + avg(CASE WHEN seg_name <> '' THEN 1.0 ELSE 0 END)), 6) FROM checked) AS mask_score FROM m""",
)
def inferred_schema(spark, folder):
    found = inferred(spark, folder).select(
        "image_col", "image_col_by_name", "mask_col", F.array_join("label_cols", ",").alias("label_cols"),
        F.array_join("meta_cols", ",").alias("meta_cols"), "mode", "target_encoding", "binary_cols_count", "image_col_match",
        F.col("image_candidates")[0]["score"].alias("image_score"), F.col("mask_candidates")[0]["score"].alias("mask_score"),
    )
    return r6(found, "image_col_match", "image_score", "mask_score")


def _summary_sql() -> str:
    values = {k: f"CAST({sql} AS VARCHAR)" for k, sql in TOTALS.items()}
    values |= {k: f"'{PLACES[k]}'" if k in PLACES else "'None'" for k in profile.PLACES}
    values |= {
        "csv_rows": values["audit_total_rows"], "csv_cols": "'8'", "image_col_inferred": "'image'", "mask_col_inferred": "'seg_name'",
        "mode_inferred": "(SELECT mode FROM m)", "target_encoding": "(SELECT target_encoding FROM m)",
        "label_cols_count": "'4'", "meta_cols_count": "'1'",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS key, {values[k]} AS value" for k in profile.SUMMARY_KEYS)


@query("a14_full_summary", f"WITH {V_REPEATS}, m AS ({ONE_HOT_MODE}) {_summary_sql()}")
def a14_full(spark, folder):
    manifest = repeats(spark, folder)
    return profile.full_summary(
        checked(spark, folder), image_files(spark, folder), mask_files(spark, folder), inferred(spark, folder), PLACES, manifest.columns
    )
