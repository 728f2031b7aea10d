"""Projection, filter and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import views as v
from tallyframe.catalog.registry import query
from tallyframe.functions import names, values
from tallyframe.operators import contract, items, models, profile, resolve, runs
from tallyframe.sources import history as hist

EXTS = ("html", "htm", "jpg")
STEM_SQL = r"regexp_replace(lower(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1)), '^(.+)\.(html|htm|jpg)$', '\1')"


@query(
    "p1_normalize_names",
    """SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '\\s+', '_', 'g'),
              '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name
       FROM (SELECT p_partkey, ' ' || p_name || ' (' || p_brand || ')__' AS t FROM part)""",
)
def p1(spark, folder):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")__"))
    return v.table(spark, folder, "part").select("p_partkey", names.normalize_name_col(raw).alias("name"))


@query(
    "p2_normalize_id",
    f"""WITH {v.V_FILES} SELECT id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1') AS item_id
        FROM v_files""",
)
def p2(spark, folder):
    return v.files(spark, folder).select("id", names.normalize_id("path").alias("item_id"))


@query("p3_norm_stem", f"WITH {v.V_FILES} SELECT id, {STEM_SQL} AS stem FROM v_files")
def p3(spark, folder):
    return v.files(spark, folder).select("id", names.norm_stem("path", EXTS).alias("stem"))


@query(
    "p4_mask_aliases",
    f"""WITH {v.V_ALIAS} SELECT DISTINCT id, alias FROM (
          SELECT id, mask_stem AS alias FROM v_alias
          UNION ALL SELECT id, regexp_replace(mask_stem, '(_mask|-mask| mask|_seg|-seg|_segmentation|-segmentation)$', '')
            FROM v_alias
          UNION ALL SELECT id, regexp_replace(mask_stem, '^(mask_|mask-)', '') FROM v_alias)
        WHERE alias IS NOT NULL""",
)
def p4(spark, folder):
    return v.alias(spark, folder).select("id", F.explode(names.mask_aliases("mask_stem")).alias("alias"))


SUFFIXES_SQL = """sfx AS (SELECT unnest(['', '_mask', '-mask', '_seg', '-seg', '_segmentation', '-segmentation',
  '_lesion', '_lesion_mask', '_binary', '_annotation', '_ann']) AS s, unnest(range(12)) AS i)"""


@query(
    "p5_mask_candidates",
    f"""WITH {v.V_ALIAS}, {SUFFIXES_SQL}
        SELECT id, CAST(i AS INT) AS prio, lower(mask_stem) || s AS key FROM v_alias, sfx WHERE mask_stem IS NOT NULL
        UNION ALL
        SELECT id, CAST(100 + i AS INT), left(lower(mask_stem), length(mask_stem) - length(s)) FROM v_alias, sfx
        WHERE s <> '' AND ends_with(lower(mask_stem), s) AND length(mask_stem) > length(s)""",
)
def p5(spark, folder):
    return v.alias(spark, folder).select("id", F.inline(names.mask_candidates("mask_stem")))


@query(
    "p6_looks_like_filename",
    f"""WITH {v.V_FILES} SELECT id, length(trim(path)) >= 3 AND
        regexp_matches(lower(name), '^.+\\.(html|htm|jpg)$') AS is_file FROM v_files""",
)
def p6(spark, folder):
    return v.files(spark, folder).select("id", names.looks_like_filename("path", EXTS).alias("is_file"))


NUMBER_TEXT_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN props->>'$.k' WHEN 1 THEN CAST(value AS VARCHAR)
    WHEN 2 THEN ' -' || (props->>'$.k') || ' ' WHEN 3 THEN event_type WHEN 4 THEN (props->>'$.k') || 'e2' ELSE '' END AS t
    FROM events"""


def number_text(spark, folder):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, k)
        .when(kind == 1, F.col("value").cast("string"))
        .when(kind == 2, F.concat(F.lit(" -"), k, F.lit(" ")))
        .when(kind == 3, F.col("event_type"))
        .when(kind == 4, F.concat(k, F.lit("e2")))
        .otherwise("")
    )
    return v.table(spark, folder, "events").select("event_id", text.alias("t"))


@query(
    "p7_to_number",
    f"""SELECT event_id, CASE WHEN w THEN 'int' WHEN d IS NOT NULL THEN 'float' ELSE 'text' END AS kind,
               CASE WHEN w THEN TRY_CAST(trim(t) AS BIGINT) END AS as_long, CASE WHEN NOT w THEN d END AS as_double,
               CASE WHEN d IS NULL THEN trim(t) END AS as_text
        FROM (SELECT event_id, t, regexp_full_match(trim(t), '-?[0-9]+') AS w, TRY_CAST(trim(t) AS DOUBLE) AS d
              FROM ({NUMBER_TEXT_SQL}))""",
)
def p7(spark, folder):
    return number_text(spark, folder).select("event_id", values.to_number("t").alias("n")).select("event_id", "n.*")


@query(
    "p8_coerce_int0",
    f"""SELECT event_id, CAST(trunc(coalesce(TRY_CAST(trim(t) AS DOUBLE), 0)) AS BIGINT) AS whole
        FROM ({NUMBER_TEXT_SQL})""",
)
def p8(spark, folder):
    return number_text(spark, folder).select("event_id", values.coerce_int0("t").alias("whole"))


@query(
    "p9_decode_one_hot",
    f"""WITH {v.V_ONEHOT}, {v.V_MULTI}
        SELECT 'onehot' AS kind, id, concat_ws('|', CASE WHEN en = 1 THEN 'en' END, CASE WHEN de = 1 THEN 'de' END,
               CASE WHEN fr = 1 THEN 'fr' END, CASE WHEN es = 1 THEN 'es' END) AS target FROM v_onehot
        UNION ALL SELECT 'multi', id, concat_ws('|', CASE WHEN quality = 1 THEN 'quality' END,
               CASE WHEN toxic = 1 THEN 'toxic' END) FROM v_multi""",
)
def p9(spark, folder):
    parts = [
        values.decode_one_hot(df).select(F.lit(kind).alias("kind"), "id", "target")
        for kind, df in (("onehot", v.onehot(spark, folder)), ("multi", v.multi(spark, folder)))
    ]
    return parts[0].unionByName(parts[1])


LANG_NAMES = {"en": "English", "de": "German", "fr": "French"}


@query(
    "p10_pretty_label",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French'
       ELSE lang END AS pretty FROM documents""",
)
def p10(spark, folder):
    return v.table(spark, folder, "documents").select("doc_id", values.pretty_label("lang", LANG_NAMES).alias("pretty"))


@query("p11_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001')")
def p11(spark, folder):
    return items.search(v.table(spark, folder, "customer").select("c_custkey", "c_name"), " R#00000001 ", "c_name")


@query(
    "p12_issue_codes",
    f"""WITH {v.V_MANIFEST} SELECT id, concat_ws('|', CASE WHEN NOT image_exists THEN 'IMAGE_NOT_FOUND_ON_DISK' END,
        CASE WHEN NOT mask_exists THEN 'MASK_NOT_FOUND_ON_DISK' END) AS issues FROM v_manifest""",
)
def p12(spark, folder):
    docs, labels = v.table(spark, folder, "documents"), v.table(spark, folder, "labels")
    found = docs.select("doc_id").join(labels, "doc_id", "left")
    rules = [
        (F.col("quality").isNull(), "IMAGE_NOT_FOUND_ON_DISK"),
        (F.coalesce("quality", F.lit(0)) != 1, "MASK_NOT_FOUND_ON_DISK"),
    ]
    return found.select(F.col("doc_id").alias("id"), values.issue_codes(*rules).alias("issues"))


@query("p13_safe_str", "SELECT doc_id, coalesce(nullif(lang, 'en'), '') AS lang, CAST(n_chars AS VARCHAR) AS chars FROM documents")
def p13(spark, folder):
    return v.table(spark, folder, "documents").select(
        "doc_id", values.safe_str(F.nullif(F.col("lang"), F.lit("en"))).alias("lang"), values.safe_str("n_chars").alias("chars")
    )


@query(
    "p14_relative_path",
    f"""WITH {v.V_FILES} SELECT id, CASE WHEN starts_with(path, 'https://') THEN substr(path, 9) ELSE path END AS rel FROM v_files""",
)
def p14(spark, folder):
    rows = v.files(spark, folder)
    return rows.select("id", names.relative_to("path", "https:/").alias("rel")).select(
        "id", F.when(F.col("rel").startswith("/"), F.substring("rel", F.lit(2), F.length("rel"))).otherwise(F.col("rel")).alias("rel")
    )


@query(
    "p15_upload_ext",
    f"""WITH {v.V_FILES} SELECT id, CASE WHEN id % 3 = 0 THEN '.jpeg' WHEN id % 3 = 1 THEN '.png' ELSE '.jpg' END AS ext
        FROM v_files""",
)
def p15(spark, folder):
    kind = F.col("id") % 3
    name = F.when(kind == 0, F.concat("name", F.lit("x.JPEG"))).when(kind == 1, F.concat("name", F.lit(".gif"))).otherwise("")
    content = F.when(kind == 1, "IMAGE/png").otherwise("application/octet-stream")
    return v.files(spark, folder).select("id", names.upload_ext(name, content).alias("ext"))


@query(
    "p16_valid_items",
    f"WITH {v.V_MANIFEST} SELECT id AS row_idx, mask_exists FROM v_manifest WHERE image_exists",
)
def p16(spark, folder):
    return resolve.valid_items(audited(spark, folder)).select("row_idx", "mask_exists")


def audited(spark, folder):
    return resolve.audit(
        v.manifest(spark, folder),
        v.manifest_images(spark, folder),
        v.manifest_masks(spark, folder),
        image_col="image",
        row_idx="id",
        images_dir="img",
        masks_dir="msk",
    )


CONTRACT_SQL = """contracts AS (SELECT c_custkey,
  CASE c_custkey % 4 WHEN 0 THEN '{"image_col":"' || c_name || '","mode":"single_label","label_cols":["a","b"]}'
    WHEN 1 THEN '{"image_col":"","target_definition":{"image_col":"' || c_name || '","source_encoding":"' || c_mktsegment || '"}}'
    WHEN 2 THEN '{"columns":{"image_col":"' || c_name || '","label_cols":[]},"target_definition":{"label_cols":["c"],"mode":"multi_label"}}'
    ELSE '{"image_col":null,"mode":" "}' END AS document FROM customer)"""


def contracts(spark, folder):
    kind = F.col("c_custkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"image_col":"'), "c_name", F.lit('","mode":"single_label","label_cols":["a","b"]}')))
        .when(
            kind == 1,
            F.concat(
                F.lit('{"image_col":"","target_definition":{"image_col":"'), "c_name",
                F.lit('","source_encoding":"'), "c_mktsegment", F.lit('"}}'),
            ),
        )
        .when(
            kind == 2,
            F.concat(
                F.lit('{"columns":{"image_col":"'), "c_name",
                F.lit('","label_cols":[]},"target_definition":{"label_cols":["c"],"mode":"multi_label"}}'),
            ),
        )
        .otherwise('{"image_col":null,"mode":" "}')
    )
    return v.table(spark, folder, "customer").select("c_custkey", text.alias("document"))


def _first_path(*paths: str) -> str:
    tries = [f"CASE WHEN trim(document->>'$.{p}') NOT IN ('', '[]', 'null') THEN document->>'$.{p}' END" for p in paths]
    return "coalesce(" + ", ".join(tries) + ")"


@query(
    "p17_pick_path",
    f"""WITH {CONTRACT_SQL} SELECT c_custkey,
        {_first_path('image_col', 'columns.image_col', 'target_definition.image_col')} AS image_col,
        {_first_path('label_cols', 'columns.label_cols', 'target_definition.label_cols')} AS label_cols,
        {_first_path('mode', 'target_definition.mode')} AS mode FROM contracts""",
)
def p17(spark, folder):
    fields = contract.contract_fields()
    return contracts(spark, folder).select("c_custkey", *[fields[c].alias(c) for c in ("image_col", "label_cols", "mode")])


# by c_custkey % 6; one text in six is no JSON, @ stands for the customer's name
ROLE_DOCUMENTS = (
    '{"labels":["a","b"],"task_mode":"single_label","filename_col":"@"}',
    '{"target":{"label_columns":["a","b",3]},"schema":{"image":"@"},"mask":{"policy":"require"}}',
    '{"data":{"path_col":"@","target_cols":["x"]},"mode":"multi_label","encoding":"one_hot_multiclass","mask_policy":"@","mask":{"policy":"x"}}',
    '{"image_col":7,"target_config":{"image_col":"@"},"label_cols":"a","columns":{"labels":["q","r"]},"target":["mode"]}',
    '{"mode":null,"contract":{"encoding":"@","mode":"single_label"},"labels":["0","1"],"image":"","data":{"image_col":"@"}}',
    '{"labels":',
)


def role_documents(spark, folder):
    texts = F.array(*[F.lit(t) for t in ROLE_DOCUMENTS])
    text = F.replace(F.get(texts, (F.col("c_custkey") % 6).cast("int")), F.lit("@"), F.col("c_name"))
    return v.table(spark, folder, "customer").select("c_custkey", text.alias("document"))


def _first_json(paths: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(j, '$.{p}') <> 'NULL' THEN json_extract(j, '$.{p}') END" for p in paths) + ")"


def _roles_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN replace('{t}', '@', c_name)" for i, t in enumerate(ROLE_DOCUMENTS))
    fields = {f: contract.places_of(f) for f in contract.SYNONYMS} | {"mask_policy": list(contract.MASK_POLICY)}
    found = ", ".join(f"{_first_json(paths)} AS v_{f}" for f, paths in fields.items())
    texts = ", ".join(f"CASE WHEN json_type(v_{f}) = 'VARCHAR' THEN v_{f}->>'$' END AS {f}" for f in fields if f != "label_cols")
    return f"""WITH d AS (SELECT c_custkey, CASE c_custkey % 6 {cases} END AS t FROM customer),
      p AS (SELECT c_custkey, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM d), f AS (SELECT c_custkey, {found} FROM p),
      r AS (SELECT c_custkey, v_mode, CASE WHEN json_type(v_label_cols) = 'ARRAY' THEN CAST(v_label_cols AS VARCHAR[]) END AS labs, {texts} FROM f)
      SELECT c_custkey, image_col, array_to_string(labs, ',') AS label_cols, CASE WHEN v_mode IS NULL THEN 'single_label' ELSE mode END AS mode,
        target_encoding, mask_policy,
        concat_ws('|', CASE WHEN coalesce(len(labs), 0) < 2 THEN 'LABEL_COLS_INVALID' END,
          CASE WHEN coalesce(image_col, '') = '' THEN 'IMAGE_COL_INVALID' END,
          CASE WHEN v_mode IS NOT NULL AND coalesce(mode, '') <> 'single_label' THEN 'MODE_UNSUPPORTED' END) AS errors,
        concat_ws('|', CASE WHEN v_mode IS NULL THEN 'MODE_ASSUMED' END, CASE WHEN target_encoding IS NULL THEN 'ENCODING_MISSING' END,
          CASE WHEN target_encoding <> 'one_hot_multiclass' THEN 'ENCODING_UNEXPECTED' END) AS warnings FROM r"""


@query("p17_contract_roles", _roles_sql())
def p17_roles(spark, folder):
    roles = contract.contract_roles(role_documents(spark, folder), keys=["c_custkey"])
    return roles.withColumn("label_cols", F.array_join("label_cols", ","))


@query(
    "p18_label_map",
    """SELECT p_partkey, CAST(i AS INT) AS idx, CASE i WHEN 0 THEN p_brand ELSE p_type END AS label,
         CASE p_partkey % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'wrapped_list:index_to_label' WHEN 2 THEN 'label_to_idx_dict'
              ELSE 'digit_key_dict' END AS rule
       FROM part, (SELECT unnest([0, 1]) AS i)""",
)
def p18(spark, folder):
    kind = F.col("p_partkey") % 4
    two = F.concat(F.lit('"'), "p_brand", F.lit('","'), "p_type", F.lit('"'))
    text = (
        F.when(kind == 0, F.concat(F.lit("["), two, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"index_to_label":['), two, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"'), "p_type", F.lit('":1,"'), "p_brand", F.lit('":0}')))
        .otherwise(F.concat(F.lit('{"1":"'), "p_type", F.lit('","0":"'), "p_brand", F.lit('"}')))
    )
    docs = v.table(spark, folder, "part").select("p_partkey", text.alias("document"))
    return contract.label_dim(docs, ["a", "b"], keys=["p_partkey"])


@query(
    "p18_label_types",
    """SELECT p_partkey, CAST(i AS INT) AS idx,
         CASE p_partkey % 3 WHEN 0 THEN CAST(1 - i AS VARCHAR) WHEN 1 THEN CASE i WHEN 0 THEN 'b' ELSE 'a' END ELSE CASE i WHEN 0 THEN 'a' ELSE 'b' END END AS label,
         CASE p_partkey % 3 WHEN 0 THEN 'col_to_label_aligned_by_label_cols' WHEN 1 THEN 'label_to_idx_dict' ELSE 'fallback_use_label_cols' END AS rule
       FROM part, (SELECT unnest([0, 1]) AS i)""",
)
def p18_types(spark, folder):
    """The same map with labels as texts, as numbers, and as a mixture that is neither."""
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, '{"a":"1","b":"0"}').when(kind == 1, '{"a":1,"b":0}').otherwise('{"a":1,"b":"0"}')
    docs = v.table(spark, folder, "part").select("p_partkey", text.alias("document"))
    return contract.label_dim(docs, ["a", "b"], keys=["p_partkey"])


@query(
    "p19_argmax",
    f"WITH {v.V_FEATURES} SELECT id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS place FROM v_features",
)
def p19(spark, folder):
    return v.features(spark, folder).select("id", values.argmax("x").alias("place"))


@query(
    "p20_is_close",
    """SELECT l_orderkey, l_linenumber, l_quantity, abs(1 + l_tax / 10 - l_discount / 10 - 1) <= 0.001 + 0.00001 AS close
       FROM lineitem""",
)
def p20(spark, folder):
    value = 1 + F.col("l_tax") / 10 - F.col("l_discount") / 10
    return v.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", values.is_close(value).alias("close"))


@query("p21_out_of_range", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 3 AND 45)")
def p21(spark, folder):
    return contract.out_of_range(v.table(spark, folder, "part").select("p_partkey", "p_size"), "p_size", 3, 45)


@query("p23_meta_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def p23(spark, folder):
    return profile.meta_columns(v.table(spark, folder, "customer"), ["c_mktsegment"], ["c_name"])


@query(
    "p24_meta_entries",
    """SELECT doc_id, unnest(['lang', 'source', 'chars']) AS key, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS value
       FROM documents WHERE lang <> 'en'
       UNION ALL SELECT doc_id, unnest(['source', 'chars']), unnest([source, CAST(n_chars AS VARCHAR)]) FROM documents
       WHERE lang = 'en'""",
)
def p24(spark, folder):
    pairs = [
        F.lit("lang"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("source"), F.col("source"),
        F.lit("target"), F.col("lang"), F.lit("chars"), F.col("n_chars").cast("string"), F.lit("none"), F.lit(None).cast("string"),
    ]
    return v.table(spark, folder, "documents").select("doc_id", F.explode(values.meta_entries(F.create_map(*pairs))))


@query("p25_valid_runs", f"WITH {v.V_RUNS} SELECT * FROM v_runs WHERE val_f1_macro IS NOT NULL")
def p25(spark, folder):
    return runs.valid_runs(v.runs(spark, folder))


@query(
    "p26_stamp_predictions",
    f"""WITH {v.V_HISTORY}, v_ids AS (SELECT *, md5('run-1:' || filename) AS h FROM v_history),
       v_keyed AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
         || substr(h, 21, 12) AS new_id FROM v_ids)
       SELECT new_id AS id, filename, label, score, true AS stamped, 'storage/predictions/' || new_id || '.png' AS image_relpath FROM v_keyed""",
)
def p26(spark, folder):
    rows = v.history(spark, folder).select("filename", "label", "score", names.upload_ext("filename", F.lit("")).alias("ext"))
    stamped = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    made = models.stamp_predictions(rows, "storage/predictions", run="run-1")
    return made.select("id", "filename", "label", "score", stamped.alias("stamped"), "image_relpath")


@query(
    "p27_display_text",
    """SELECT event_id, printf('%.2f', value) AS score_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_text FROM events""",
)
def p27(spark, folder):
    return v.table(spark, folder, "events").select(
        "event_id", values.score_text("value").alias("score_text"), values.date_text("ts").alias("date_text")
    )


@query(
    "p28_public_history",
    f"""WITH {v.V_HISTORY} SELECT id, filename, label, score, created_at,
        '/api/predictions/' || id || '/image' AS image_url FROM v_history""",
)
def p28(spark, folder):
    return hist.public_history(v.history(spark, folder))


@query("p29_filter_policy", f"WITH {v.V_MULTI} SELECT id, quality, toxic FROM v_multi WHERE quality + toxic = 1")
def p29(spark, folder):
    return contract.apply_policy(v.multi(spark, folder), contract.one_hot_ok(["quality", "toxic"]), "filter")


@query(
    "p30_normalize_channels",
    f"""WITH {v.V_FEATURES} SELECT id, CAST(i AS INT) AS place, round((v - CASE i % 3 WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END)
           / CASE i % 3 WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END, 6) AS value
        FROM (SELECT id, unnest(x) AS v, unnest(range(64)) AS i FROM v_features)""",
)
def p30(spark, folder):
    mean, std = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    normal = values.normalize_channels("x", mean, std)
    return v.features(spark, folder).select("id", F.posexplode(normal).alias("place", "value")).select(
        "id", "place", F.round("value", 6).alias("value")
    )


@query(
    "p31_numeric_columns",
    f"""SELECT 't' AS column, avg(CASE WHEN TRY_CAST(trim(t) AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.8 AS numeric_like
        FROM ({NUMBER_TEXT_SQL})
        UNION ALL SELECT 'event_id', true
        UNION ALL SELECT 'k', avg(CASE WHEN TRY_CAST(props->>'$.k' AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.8 FROM events""",
)
def p31(spark, folder):
    k = v.table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return profile.numeric_columns(number_text(spark, folder)).unionByName(
        profile.numeric_columns(k).where(F.col("column") == "k")
    )


@query(
    "p33_binarize",
    f"""WITH {v.V_FEATURES} SELECT id, CAST(list_sum([CASE WHEN e > 0 THEN 1 ELSE 0 END FOR e IN x]) AS BIGINT) AS set_places
        FROM v_features""",
)
def p33(spark, folder):
    ones = F.aggregate(values.binarize("x"), F.lit(0).cast("bigint"), lambda acc, b: acc + b)
    return v.features(spark, folder).select("id", ones.alias("set_places"))


@query(
    "p35_list_items",
    f"WITH {v.V_ALIAS} SELECT stem AS id, mask_stem IS NOT NULL AS has_mask FROM v_alias",
)
def p35(spark, folder):
    return items.list_items(resolve.images_by_id(v.alias_images(spark, folder)), v.alias_masks(spark, folder))
