"""Join, set-operation and first/last-per-key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import views as v
from tallyframe.catalog.columns import EXTS, STEM_SQL, SUFFIXES_SQL, audited
from tallyframe.catalog.registry import query
from tallyframe.functions import names
from tallyframe.operators import contract, items, metrics, profile, resolve, weights
from tallyframe.sources import history as hist

ROW = ["l_orderkey", "l_linenumber"]


def item_index(spark, folder):
    meta = F.create_map(F.lit("lang"), "lang", F.lit("n"), F.col("n_chars").cast("string"))
    return v.table(spark, folder, "documents").select(
        F.concat(F.lit("IMG_"), F.col("doc_id").cast("string")).alias("id"), meta.alias("meta")
    )


@query(
    "j1_item_meta",
    """SELECT 'IMG_' || p_partkey AS id, d.lang, CAST(d.n_chars AS VARCHAR) AS chars
       FROM part LEFT JOIN documents d ON d.doc_id = p_partkey""",
)
def j1(spark, folder):
    images = resolve.images_by_id(v.alias_images(spark, folder)).select("id")
    joined = items.with_meta(images, item_index(spark, folder))
    return joined.select("id", F.try_element_at("meta", F.lit("lang")).alias("lang"), F.try_element_at("meta", F.lit("n")).alias("chars"))


@query(
    "j2_attach_masks",
    f"""WITH {v.V_ALIAS}, al AS (
          SELECT mask_stem, mask_stem AS id FROM v_alias
          UNION SELECT mask_stem, regexp_replace(mask_stem, '(_mask|-mask| mask|_seg|-seg|_segmentation|-segmentation)$', '') FROM v_alias
          UNION SELECT mask_stem, regexp_replace(mask_stem, '^(mask_|mask-)', '') FROM v_alias),
        m AS (SELECT id, arg_min('msk/' || mask_stem || '.png', lower(mask_stem)) AS mask_path FROM al GROUP BY id)
        SELECT stem AS id, mask_path FROM v_alias LEFT JOIN m ON m.id = stem""",
)
def j2(spark, folder):
    found = resolve.attach_masks(resolve.images_by_id(v.alias_images(spark, folder)), v.alias_masks(spark, folder))
    return found.select("id", "mask_path")


VALUE_SQL = r"""asked AS (
  SELECT *, regexp_extract(p, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1') AS stem,
         regexp_replace(lower(regexp_extract(p, '([^/]*)$', 1)), '^(.+)\.(jpg|jpeg|png|bmp|tif|tiff|webp)$', '\1') AS low
  FROM (SELECT *, replace(trim(image), '\', '/') AS p FROM part_rows)),
stems AS (SELECT regexp_replace(lower(regexp_extract(path, '([^/]*)$', 1)), '\.(jpg|jpeg|png|bmp|tif|tiff|webp)$', '') AS stem,
                 min(path) AS path FROM part_files GROUP BY 1),
prefixes AS (SELECT key, min(path) AS path FROM (
    SELECT regexp_replace(path, '^([^.]*)\..*$', '\1') AS key, path FROM part_files
    UNION ALL SELECT regexp_replace(path, '^(.+)\.[^.]+$', '\1'), path FROM part_files) GROUP BY key)"""
KNOWN = "regexp_matches(lower(name), '^.+\\.(jpg|jpeg|png|bmp|tif|tiff|webp)$')"


def cascade_sql(keys: list[str], last: str = "") -> str:
    """Rows with the first existing path among ``keys``."""
    joins = "".join(f"\n LEFT JOIN part_files f{i} ON f{i}.path = {k}" for i, k in enumerate(keys))
    paths = ", ".join([f"f{i}.path" for i in range(len(keys))] + (["g.path"] if last else []))
    return f"""WITH {v.V_PARTS}, {VALUE_SQL} SELECT l_orderkey, l_linenumber, image, coalesce({paths}, '') AS resolved
        FROM asked {joins} {last}"""


def resolved(spark, folder, strategy):
    found = resolve.resolve_images(
        v.part_rows(spark, folder), v.part_files(spark, folder), "image", ROW, strategy, images_dir="img"
    )
    return found.select(*ROW, "image", F.coalesce("resolved_path", F.lit("")).alias("resolved"))


@query(
    "j3_resolve_by_stem",
    cascade_sql([f"CASE WHEN {KNOWN} THEN 'img/' || name END"], "LEFT JOIN stems g ON g.stem = low AND low <> ''"),
)
def j3(spark, folder):
    return resolved(spark, folder, "stem")


@query(
    "j4_resolve_in_project",
    cascade_sql(["p", "'img/' || name"] + [f"'img/' || stem || '.{e}'" for e in names.PROJECT_IMAGE_EXTS]),
)
def j4(spark, folder):
    return resolved(spark, folder, "project")


@query(
    "j5_resolve_with_glob",
    cascade_sql(
        ["p", "'img/' || name", "'img/' || p"] + [f"'img/' || stem || '.{e}'" for e in names.ALL_IMAGE_EXTS],
        "LEFT JOIN prefixes g ON g.key = 'img/' || stem",
    ),
)
def j5(spark, folder):
    return resolved(spark, folder, "glob")


@query(
    "j6_resolve_masks",
    f"""WITH {v.V_ALIAS}, {SUFFIXES_SQL}, ask AS (
          SELECT id, lower(CASE WHEN id % 7 = 3 THEN stem || '_seg' ELSE stem END) AS s FROM v_alias),
        cand AS (SELECT id, i AS prio, a.s || sfx.s AS key FROM ask a, sfx
          UNION ALL SELECT id, 100 + i, left(a.s, length(a.s) - length(sfx.s)) FROM ask a, sfx
          WHERE sfx.s <> '' AND ends_with(a.s, sfx.s)),
        m AS (SELECT lower(mask_stem) AS key, min('msk/' || mask_stem || '.png') AS path FROM v_alias
              WHERE mask_stem IS NOT NULL GROUP BY 1),
        best AS (SELECT id, arg_min(path, prio) AS mask_path FROM cand JOIN m USING (key) GROUP BY id)
        SELECT ask.id, mask_path FROM ask LEFT JOIN best ON best.id = ask.id""",
)
def j6(spark, folder):
    stem = F.when(F.col("id") % 7 == 3, F.concat("stem", F.lit("_seg"))).otherwise(F.col("stem"))
    asked = v.alias(spark, folder).select("id", stem.alias("stem"))
    return resolve.resolve_masks(asked, v.alias_masks(spark, folder), "stem", ["id"]).select("id", "mask_path")


@query(
    "j7_manifest_audit",
    f"""WITH {v.V_MANIFEST} SELECT id AS row_idx, 'image' AS image_col_used, 'data/Doc_' || id || '.jpg' AS csv_image_value,
          'doc_' || id AS image_stem, CASE WHEN image_exists THEN 'img/doc_' || id || '.JPG' ELSE '' END AS resolved_image_rel,
          image_exists, '' AS mask_col_used, '' AS csv_mask_value,
          CASE WHEN mask_exists THEN 'msk/doc_' || id || '_segmentation.png' ELSE '' END AS resolved_mask_rel, mask_exists,
          concat_ws('|', CASE WHEN NOT image_exists THEN 'IMAGE_NOT_FOUND_ON_DISK' END,
                    CASE WHEN NOT mask_exists THEN 'MASK_NOT_FOUND_ON_DISK' END) AS issues
        FROM v_manifest""",
)
def j7(spark, folder):
    return audited(spark, folder)


@query(
    "j8_with_exists",
    """SELECT event_id, user_id, user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS known FROM events""",
)
def j8(spark, folder):
    keys = v.table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    rows = v.table(spark, folder, "events").select("event_id", "user_id")
    return resolve.with_exists(rows, keys, "user_id", ["event_id"], "known").select("event_id", "user_id", "known")


@query("j9_files_only", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9(spark, folder):
    docs = v.table(spark, folder, "documents").select("doc_id", "lang")
    return resolve.files_only(docs, v.table(spark, folder, "labels"), "doc_id", ["doc_id"])


@query(
    "j10_manifest_only",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def j10(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    lines = v.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return resolve.manifest_only(orders, lines, "o_orderkey", ["o_orderkey"])


@query(
    "j11_full_grid",
    f"""WITH {v.V_SCORED} SELECT CAST(a.i AS INT) AS y_true, CAST(b.i AS INT) AS y_pred, coalesce(n, 0) AS n
        FROM range(10) a(i), range(10) b(i) LEFT JOIN v_counts ON v_counts.y_true = a.i AND v_counts.y_pred = b.i""",
)
def j11(spark, folder):
    return metrics.confusion_matrix(v.scored(spark, folder), v.N_CLASSES)


BALANCED_SQL = """w AS (SELECT target_index, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
  FROM v_features GROUP BY target_index)"""


@query(
    "j12_attach_weights",
    f"WITH {v.V_FEATURES}, {BALANCED_SQL} SELECT id, target_index, round(weight, 6) AS weight FROM v_features JOIN w USING (target_index)",
)
def j12(spark, folder):
    rows = v.features(spark, folder).select("id", "target_index")
    weighted = weights.attach_weights(rows, weights.balanced_weights(rows), v.N_CLASSES)
    return weighted.select("id", "target_index", F.round("weight", 6).alias("weight"))


@query(
    "j13_label_names",
    f"WITH {v.V_FEATURES} SELECT id, target_index, 'class ' || target_index AS label FROM v_features",
)
def j13(spark, folder):
    rows = v.features(spark, folder).select("id", "target_index")
    seen = rows.select("target_index").distinct()
    dim = seen.select(F.col("target_index").alias("idx"), F.concat(F.lit("class "), F.col("target_index").cast("string")).alias("label"))
    return contract.label_names(rows, dim, v.N_CLASSES).select("id", "target_index", "label")


@query(
    "j14_point_lookup",
    f"""WITH {v.V_HISTORY} SELECT id, filename, label, score, created_at, image_relpath,
        '/api/predictions/' || id || '/image' AS image_url FROM v_history WHERE id = '77'""",
)
def j14(spark, folder):
    return hist.get_prediction(v.history(spark, folder), "77")


@query(
    "j14_item_lookup",
    """SELECT 'IMG_77' AS id, 'img/IMG_77.jpg' AS image_path, 'msk/IMG_77-seg.png' AS mask_path, true AS has_mask,
       (SELECT lang FROM documents WHERE doc_id = 77) AS lang FROM part WHERE p_partkey = 77""",
)
def j14_item(spark, folder):
    images = resolve.images_by_id(v.alias_images(spark, folder))
    found = items.get_item(images, v.alias_masks(spark, folder), item_index(spark, folder), "IMG_77")
    return found.select("id", "image_path", "mask_path", "has_mask", F.try_element_at("meta", F.lit("lang")).alias("lang"))


@query(
    "w1_first_per_key",
    """SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn
       FROM documents) WHERE rn = 1""",
)
def w1(spark, folder):
    return resolve.first_per_key(
        v.table(spark, folder, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"]
    )


@query(
    "w2_last_per_key",
    """SELECT l_orderkey, l_shipdate_text, l_extendedprice FROM (
         SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text, l_extendedprice,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY strftime(l_shipdate, '%Y-%m-%d') DESC, l_extendedprice DESC) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def w2(spark, folder):
    rows = v.table(spark, folder, "lineitem").select(
        "l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate_text"), "l_extendedprice"
    )
    return resolve.last_per_key(rows, "l_orderkey", ["l_shipdate_text", "l_extendedprice"])


@query(
    "w3_flag_duplicates",
    "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicate FROM documents",
)
def w3(spark, folder):
    rows = v.table(spark, folder, "documents").select("doc_id", resolve.text_key("text").alias("k"))
    return resolve.flag_duplicates(rows, "k", ["doc_id"]).select("doc_id", "duplicate")


@query(
    "u1_diff_keys",
    """SELECT 'left_only' AS side, k FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey + 100 FROM lineitem)
       UNION ALL SELECT 'right_only', k FROM (SELECT l_orderkey + 100 AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders)""",
)
def u1(spark, folder):
    a = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    b = v.table(spark, folder, "lineitem").select((F.col("l_orderkey") + 100).alias("k"))
    return resolve.diff_keys(a, b, "k")


@query("u2_distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u2(spark, folder):
    return v.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    "a33_stem_index",
    f"""WITH {v.V_FILES}, s AS (SELECT path, {STEM_SQL} AS stem FROM v_files)
        SELECT stem, path, count(*) OVER (PARTITION BY stem) AS n_paths, min(path) OVER (PARTITION BY stem) AS first_path FROM s""",
)
def a33(spark, folder):
    found = resolve.stem_index(v.files(spark, folder).select("path"), EXTS)
    return found.select("stem", "path", "n_paths", "first_path")


@query(
    "q1_clean_dataset",
    f"""WITH {v.V_MANIFEST} SELECT 'doc_' || id AS image_stem, id AS row_idx, 'img/doc_' || id || '.JPG' AS image_path, mask_exists
        FROM v_manifest WHERE image_exists""",
)
def q1(spark, folder):
    return resolve.clean_dataset(audited(spark, folder))


@query(
    "a13_audit_totals",
    f"""WITH {v.V_MANIFEST} SELECT count(*) AS rows, count(*) FILTER (NOT image_exists) AS images_missing,
        count(*) FILTER (NOT mask_exists) AS masks_missing, count(*) FILTER (NOT image_exists OR NOT mask_exists) AS rows_with_issues
        FROM v_manifest""",
)
def a13(spark, folder):
    return profile.audit_totals(audited(spark, folder))


@query(
    "a14_audit_summary",
    f"""WITH {v.V_MANIFEST}, n AS (SELECT count(*) AS docs FROM documents), l AS (SELECT count(*) AS labs,
          count(*) FILTER (quality = 1) AS masks FROM labels)
        SELECT unnest(['audit_total_rows', 'audit_images_missing', 'audit_masks_missing', 'image_files_on_disk', 'mask_files_on_disk',
               'disk_only_image_stems', 'csv_only_image_stems', 'csv_duplicate_stems', 'disk_duplicate_image_stems',
               'disk_duplicate_mask_stems', 'mode_inferred']) AS key,
               unnest([CAST(docs AS VARCHAR), CAST(docs - labs AS VARCHAR), CAST(docs - masks AS VARCHAR), CAST(labs AS VARCHAR),
               CAST(masks AS VARCHAR), '0', CAST(docs - labs AS VARCHAR), '0', '0', '0', 'single_label']) AS value
        FROM n, l""",
)
def a14(spark, folder):
    return profile.audit_summary(
        audited(spark, folder), v.manifest_images(spark, folder), v.manifest_masks(spark, folder), {"mode_inferred": "single_label"}
    )


@query(
    "q10_mask_coverage",
    f"WITH {v.V_MANIFEST} SELECT round(avg(CASE WHEN mask_exists THEN 1.0 ELSE 0.0 END), 6) AS mask_coverage FROM v_manifest WHERE image_exists",
)
def q10_coverage(spark, folder):
    return metrics.mask_coverage(audited(spark, folder)).select(F.round("mask_coverage", 6).alias("mask_coverage"))
