"""Queries that write a table, read it back and go on: sources, sinks, history, models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyframe.catalog import views as v
from tallyframe.catalog.columns import CONTRACT_SQL, contracts
from tallyframe.catalog.registry import query, scratch
from tallyframe.functions import names
from tallyframe.operators import contract, features, metrics, models, resolve, runs
from tallyframe.operators.split import stratified_split
from tallyframe.sources import documents, files, manifest, sinks
from tallyframe.sources import history as hist
from tallyframe.streaming.ingest import ingest_history


@query(
    "s1_manifest_scan",
    """SELECT 'IMG ' || p_partkey AS id, p_name, coalesce(nullif(p_brand, 'Brand#3'), '') AS p_brand, CAST(p_size AS VARCHAR) AS p_size
       FROM part""",
)
def s1(spark, folder):
    path = scratch(spark, "manifest")
    image = F.concat(F.lit("a\\b/IMG "), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    rows = v.table(spark, folder, "part").select(
        image.alias("Image"), "p_name", F.nullif(F.col("p_brand"), F.lit("Brand#3")).alias("p_brand"), "p_size"
    )
    sinks.write_csv(rows, path)
    index = manifest.manifest_index(manifest.read_manifest(spark, path))
    cells = [F.try_element_at("meta", F.lit(c)).alias(c) for c in ("p_name", "p_brand", "p_size")]
    return index.select("id", *cells)


@query(
    "s1_odd_quotes",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size || '" wide' ELSE p_name END AS size,
         CASE WHEN p_partkey % 5 = 0 THEN p_name || chr(10) || '"' || p_brand || '", ' || chr(10) ELSE p_type END AS note FROM part""",
)
def s1_odd(spark, folder):
    """Quotes inside fields without quotes, and quoted fields over several lines, in one table of many files."""
    path = scratch(spark, "odd-quotes")
    size = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit('" wide'))).otherwise(F.col("p_name"))
    long = F.concat(F.lit('"'), "p_name", F.lit('\n""'), "p_brand", F.lit('"", \n"'))
    note = F.when(F.col("p_partkey") % 5 == 0, long).otherwise(F.col("p_type"))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), size, note)
    rows = v.table(spark, folder, "part").repartition(4).select(line.alias("value"), F.spark_partition_id().alias("file"))
    header = spark.range(4).select(F.lit("id,size,note").alias("value"), F.col("id").cast("int").alias("file"))
    both = header.withColumn("at", F.lit(0)).unionByName(rows.withColumn("at", F.lit(1)))
    both.repartition("file").sortWithinPartitions("file", "at").select("value", "file").write.partitionBy("file").text(path)
    return manifest.read_manifest(spark, path, ",").select("id", "size", "note")


@query("s2_sniff_quoted", "SELECT ';' AS sep, count(*) AS records, 2 AS columns FROM part")
def s2_quoted(spark, folder):
    path = scratch(spark, "quoted-seps")
    note = F.concat(F.lit('"'), F.array_join(F.array_repeat(F.lit("x;"), F.col("p_partkey").cast("int") % 4 + 1), ""), F.lit('"'))
    rows = v.table(spark, folder, "part").select(F.concat_ws(";", F.col("p_partkey").cast("string"), note).alias("value"))
    header = spark.range(1).select(F.lit("id;note").alias("value"))
    header.unionByName(rows).coalesce(1).write.text(path)
    sep = manifest.sniff_sep(spark, path)
    read = manifest.read_manifest(spark, path, sep)
    return read.agg(F.lit(sep).alias("sep"), F.count(F.lit(1)).alias("records"), F.lit(len(read.columns) - 1).alias("columns"))


@query("s2_sniff_sep", "SELECT ';' AS sep, count(*) AS records, 4 AS columns FROM customer")
def s2(spark, folder):
    path = scratch(spark, "semicolon")
    rows = v.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows.write.option("header", True).option("sep", ";").csv(path)
    sep = manifest.sniff_sep(spark, path)
    read = manifest.read_manifest(spark, path, sep)
    return read.agg(
        F.lit(sep).alias("sep"), F.count(F.lit(1)).alias("records"), F.lit(len(read.columns) - 1).alias("columns")
    )


@query("s3_read_splits", f"WITH {v.V_SPLIT} SELECT id, target_index, split FROM v_split")
def s3(spark, folder):
    path = scratch(spark, "splits")
    manifest.write_splits(v.split(spark, folder), path)
    return manifest.read_splits(spark, path)


def text_files(spark, folder):
    path = scratch(spark, "texts")
    docs = v.table(spark, folder, "documents").select("lang", F.col("text").alias("value"))
    docs.write.partitionBy("lang").text(path)
    return path


@query(
    "s5_list_files",
    "SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1",
)
def s5(spark, folder):
    found = files.list_files(spark, text_files(spark, folder), ("txt",), recursive=True)
    lang = F.regexp_extract("path", "lang=([a-z]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(F.sum("length").alias("bytes"))


@query(
    "s15_file_fingerprint",
    "SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, true AS digests FROM documents GROUP BY 1",
)
def s15(spark, folder):
    found = files.file_fingerprint(spark, text_files(spark, folder))
    lang = F.regexp_extract("path", "lang=([a-z]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(
        F.sum("size_bytes").alias("bytes"), F.min(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("digests")
    )


@query("s15_text_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def s15_text(spark, folder):
    return v.table(spark, folder, "documents").select("doc_id", resolve.text_key("text").alias("digest"))


@query(
    "s8_json_numbers",
    "SELECT event_type, count(*) AS rows, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS DOUBLE) AS k_total FROM events GROUP BY 1",
)
def s8(spark, folder):
    k = documents.json_number("props", "k")
    return v.table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(k).alias("k_total"))


@query("s10_csv_sink", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def s10(spark, folder):
    path = scratch(spark, "csv")
    sinks.write_csv(v.table(spark, folder, "documents").select("doc_id", "text"), path)
    return manifest.read_manifest(spark, path, ",").select("doc_id", "text")


@query(
    "s11_json_sink",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def s11(spark, folder):
    path = scratch(spark, "json")
    documents.write_json_doc(v.table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.schema("c_custkey bigint, c_name string, c_mktsegment string").json(path)


@query("s12_report_lines", f"WITH {v.V_SCORED} SELECT count(*) + 3 AS lines, 64 AS width FROM v_f1")
def s12(spark, folder):
    path = scratch(spark, "report")
    lines = metrics.report_lines(metrics.classification_report(v.scored(spark, folder)))
    sinks.write_report(lines, path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("value")).alias("width"))


@query(
    "s13_score_sink",
    f"WITH {v.V_FEATURES} SELECT target_index, count(*) AS rows, round(sum(list_sum(list_slice(x, 1, 10))), 4) AS total FROM v_features GROUP BY 1",
)
def s13(spark, folder):
    path = scratch(spark, "scores")
    sinks.write_scores(v.logits(spark, folder), path)
    total = F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + x)
    return spark.read.parquet(path).groupBy("target_index").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(total), 4).alias("total")
    )


@query("s9_read_history", f"WITH {v.V_HISTORY} SELECT * FROM v_history")
def s9(spark, folder):
    path = scratch(spark, "history")
    v.history(spark, folder).write.parquet(path)
    return hist.read_history(spark, path)


@query(
    "s14_append_history",
    f"""WITH {v.V_HISTORY} SELECT id, filename, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN label ELSE 'second' END AS label, score, created_at,
        image_relpath FROM v_history""",
)
def s14(spark, folder):
    path = scratch(spark, "history")
    rows = v.history(spark, folder)
    hist.append_history(rows.where("cast(id as bigint) % 3 = 0"), path)
    hist.append_history(rows.withColumn("label", F.lit("second")), path)
    return hist.read_history(spark, path)


@query(
    "j14_stored_lookup",
    f"""WITH {v.V_HISTORY} SELECT id, filename, label, score, created_at, '/api/predictions/' || id || '/image' AS image_url
       FROM v_history WHERE id IN (SELECT CAST(min(event_id) AS VARCHAR) FROM events)""",
)
def j14_stored(spark, folder):
    """One prediction of a stored history, from the only folder that can hold it."""
    path = scratch(spark, "history")
    hist.append_history(v.history(spark, folder), path)
    first = v.table(spark, folder, "events").agg(F.min("event_id")).first()[0]
    return hist.find_prediction(spark, path, str(first)).select("id", "filename", "label", "score", "created_at", "image_url")


@query("s14_new_rows", f"WITH {v.V_HISTORY} SELECT * FROM v_history WHERE label <> 'click'")
def s14_new(spark, folder):
    rows = v.history(spark, folder)
    return hist.new_rows(rows, rows.where("label = 'click'"))


@query(
    "s17_migrate_history",
    f"WITH {v.V_HISTORY} SELECT id, filename, label, score, created_at, '' AS image_relpath FROM v_history",
)
def s17(spark, folder):
    return hist.migrate_history(v.history_old(spark, folder))


@query(
    "s18_clear_history",
    f"WITH {v.V_HISTORY} SELECT count(*) AS all_rows, count(*) FILTER (image_relpath <> '') AS deleted_rows FROM v_history",
)
def s18(spark, folder):
    return hist.clear_counts(v.history(spark, folder))


@query(
    "s21_effective_contract",
    f"""WITH {CONTRACT_SQL} SELECT c_custkey, coalesce(nullif(document->>'$.image_col', ''), document->>'$.columns.image_col',
          document->>'$.target_definition.image_col') AS image_col_from_config,
          CASE WHEN c_custkey % 2 = 0 THEN 'image_stem' ELSE coalesce(nullif(document->>'$.image_col', ''), document->>'$.columns.image_col',
          document->>'$.target_definition.image_col') END AS image_col_effective, 'abort' AS policy, 0.001::DOUBLE AS atol
        FROM contracts""",
)
def s21(spark, folder):
    docs = contracts(spark, folder)
    recovered = F.when(F.col("c_custkey") % 2 == 0, F.lit("image_stem"))
    made = contract.effective_contract(docs.withColumn("source", F.lit("config")), recovered, "config", keys=["c_custkey"])
    return made.select("c_custkey", "image_col_from_config", "image_col_effective", "policy", "atol")


def recovery_rows(spark, folder):
    k = F.col("p_partkey").cast("string")
    return v.table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("img/IMG_"), k, F.lit(".jpg")).alias("rel"),
        F.concat(F.lit("IMG_"), k).alias("stem"),
        F.col("p_name").alias("words"),
    )


@query(
    "a32_recover_key_column",
    """WITH f AS (SELECT 'img/IMG_' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.jpg' ELSE '.bmp' END AS path FROM part WHERE p_partkey % 5 <> 0),
       s AS (SELECT p_partkey, 'img/IMG_' || p_partkey AS base, p_partkey % 5 <> 0 AS hit FROM part
             ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 400)
       SELECT unnest(['rel', 'stem']) AS column, round(unnest([avg(hit::INT), avg(hit::INT)]), 6) AS ratio_resolved FROM s""",
)
def a32(spark, folder):
    path = F.concat(F.col("rel"), F.lit(""))
    kept = recovery_rows(spark, folder).where(F.col("p_partkey") % 5 != 0)
    on_disk = F.when(F.col("p_partkey") % 2 == 0, path).otherwise(F.regexp_replace("rel", "jpg$", "bmp"))
    found = contract.recover_key_column(recovery_rows(spark, folder), kept.select(on_disk.alias("path")), "p_partkey", images_dir="img")
    return found.select("column", F.round("ratio_resolved", 6).alias("ratio_resolved"))


@query("x1_ingest_history", f"WITH {v.V_HISTORY} SELECT * FROM v_history")
def x1(spark, folder):
    waiting, target, log = (scratch(spark, n) for n in ("waiting", "ingested", "ingest-log"))
    rows = v.history(spark, folder)
    rows.write.parquet(waiting)
    rows.where("label = 'view'").write.mode("append").parquet(waiting)
    ingest_history(spark, waiting, target, log).awaitTermination()
    return hist.read_history(spark, target)


# -- models ------------------------------------------------------------------------------------------------
LOGISTIC_GAP, HINGE_GAP = 1e-4, 1e-6  # shares of their objectives by which the fits may miss the optimum


def parts(spark, folder):
    rows = v.split(spark, folder, with_x=True)
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


def held_out(scored, scores, fitted, bound):
    """What SQL can state of an evaluation: rows, classes, the rows whose class has the highest score, and the proof."""
    top = F.col(scores)[F.col("y_pred")] == F.array_max(scores)
    counts = scored.groupBy("split", "target_index", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.count_if(top).alias("tops"))
    return counts.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.count_distinct("target_index").alias("classes"),
        F.sum("tops").alias("argmax_rows"),
        F.sum(F.when(F.col("y_pred").between(0, v.N_CLASSES - 1), F.col("n"))).alias("confusion_rows"),
        F.lit(fitted.gap <= bound).alias("proved"),
    )


HELD_OUT_SQL = f"""WITH {v.V_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT target_index) AS classes, count(*) AS argmax_rows,
  count(*) AS confusion_rows, true AS proved FROM v_split WHERE split <> 'train' GROUP BY 1"""


@query("m3_logreg", HELD_OUT_SQL)
def m3(spark, folder):
    train, rest = parts(spark, folder)
    fitted = models.fit_logreg(train, v.N_CLASSES, max_iter=3000, balanced=True)
    scored = fitted.transform(rest).withColumn("scores", vector_to_array("rawPrediction"))
    return held_out(scored, "scores", fitted, LOGISTIC_GAP)


@query("m4_linear_svm", HELD_OUT_SQL)
def m4(spark, folder):
    train, rest = parts(spark, folder)
    fitted = models.fit_linear_svm(train, v.N_CLASSES, bound=HINGE_GAP)
    return held_out(fitted.transform(rest), "rawPrediction", fitted, HINGE_GAP)


@query(
    "m5_probabilities",
    f"""WITH {v.V_SPLIT} SELECT id, split, target_index, {v.N_CLASSES} AS classes, true AS sums_to_one, true AS sure_of_class, true AS proved
       FROM v_split WHERE split <> 'train'""",
)
def m5(spark, folder):
    train, rest = parts(spark, folder)
    fitted = models.fit_logreg(train, v.N_CLASSES, max_iter=3000)
    total = F.aggregate("probability", F.lit(0.0), lambda acc, x: acc + x)
    return models.predict_proba(fitted, rest).select(
        "id",
        "split",
        "target_index",
        F.size("probability").alias("classes"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.col("probability")[F.col("y_pred")] == F.col("confidence")).alias("sure_of_class"),
        F.lit(fitted.gap <= LOGISTIC_GAP).alias("proved"),
    )


# images of 4 x 4 pixels at three sizes; the logistic fits stop after 20 steps, the gap that is left is part of the record
CONFIGS = {
    "logreg_32": {"family": "logreg", "input_size": 32, "max_iter": 20},
    "logreg_32_bal": {"family": "logreg", "input_size": 32, "max_iter": 20, "class_weight": "balanced"},
    "logreg_64_bal": {"family": "logreg", "input_size": 64, "max_iter": 20, "class_weight": "balanced", "seed": 7},
    "svm_8_bal": {"family": "linear_svm", "input_size": 8, "class_weight": "balanced", "bound": HINGE_GAP},
    "broken_64": {"family": "unknown", "input_size": 64, "normalization": "unit"},
}


@query(
    "m6_experiment_grid",
    f"""WITH {v.V_ONEHOT}, v_rows AS (
         SELECT CAST(sum(n) FILTER (split = 'val') AS BIGINT) AS val_rows FROM (
           SELECT lang, CASE WHEN rn * 100 <= n * 70 THEN 'train' WHEN rn * 100 <= n * 85 THEN 'val' ELSE 'test' END AS split, 1 AS n
           FROM (SELECT lang, count(*) OVER (PARTITION BY lang) AS n,
                        row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)))
       SELECT c.*, CASE WHEN error IS NULL THEN val_rows END AS confusion_rows, error IS NULL AS scored, error IS NULL AS ranked,
         error IS NULL AS gap_known, CASE WHEN family = 'linear_svm' THEN true END AS proved
       FROM (VALUES ('logreg_32', 'logreg', 32, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 42, 'cpu', CAST(NULL AS VARCHAR)),
                    ('logreg_32_bal', 'logreg', 32, NULL, 'balanced', 42, 'cpu', NULL),
                    ('logreg_64_bal', 'logreg', 64, NULL, 'balanced', 7, 'cpu', NULL),
                    ('svm_8_bal', 'linear_svm', 8, NULL, 'balanced', 42, 'cpu', NULL),
                    ('broken_64', 'unknown', 64, 'unit', NULL, 42, 'cpu', 'ValueError("unknown family ''unknown''")'))
            c(experiment_id, family, input_size, normalization, class_weight, seed, device, error), v_rows""",
)
def m6(spark, folder):
    langs = F.array(*[F.lit(x) for x in v.LANGS])
    target = (F.array_position(langs, F.col("lang")) - 1).cast("int")
    labels = v.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), target.alias("target_index"))
    labels = stratified_split(labels, "target_index", "id", allocate="per_class")
    images = v.pixels(spark, folder).join(labels, "id")
    train, val = images.where("split = 'train'"), images.where("split = 'val'")
    table = models.run_grid(CONFIGS, train, val, len(v.LANGS), "features", features_of=features.flatten_images)
    ranked = runs.rank_runs(table)
    total = F.aggregate(F.flatten("val_confusion"), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    scored = F.col("val_accuracy").between(0, 1) & F.col("val_f1_macro").between(0, 1) & (F.col("runtime_sec") > 0)
    place = F.col("rank_f1")
    return ranked.select(
        *["experiment_id", "family", "input_size", "normalization", "class_weight", "seed", "device", "error"],
        total.alias("confusion_rows"),
        F.coalesce(scored, F.lit(False)).alias("scored"),
        F.coalesce(place.between(1, len(CONFIGS) - 1), F.lit(False)).alias("ranked"),
        F.col("gap").isNotNull().alias("gap_known"),
        F.when(F.col("family") == "linear_svm", F.col("gap") <= HINGE_GAP).alias("proved"),
    )


@query(
    "m7_constant_scores",
    """SELECT event_id, 'f' || event_id || '.png' AS filename, 'suspeita' AS label, 0.71::DOUBLE AS score FROM events""",
)
def m7(spark, folder):
    rows = v.history(spark, folder).select(F.col("id").cast("bigint").alias("event_id"), "filename")
    return models.constant_scorer(rows)


def page_items(spark, folder):
    """Pages as files to score: those whose name is no number can't be decoded."""
    path = F.regexp_replace("url", "[?#].*$", "")
    name = F.concat(names.base_name(path), F.lit("-"), F.col("page_id").cast("string"), F.lit(".png"))
    return v.table(spark, folder, "pages").select(name.alias("filename"), F.lit(".png").alias("ext"), "page_id")


def decodable():
    return F.col("filename").rlike("^[0-9]+-") & (F.col("page_id") % 7 != 0)


PAGE_SQL = """pages_scored AS (SELECT batch, filename, good, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
      || '-' || substr(h, 21, 12) AS id FROM (
    SELECT *, md5(batch || ':' || filename) AS h, regexp_matches(filename, '^[0-9]+-') AND page_id % 7 <> 0 AS good FROM (
      SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch,
        regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) || '-' || page_id || '.png' AS filename FROM pages)))"""


def scored_pages(spark, folder):
    """Two batches; the first is repeated, an attempt at the second has died after its rows were written."""
    path = scratch(spark, "scored")
    items = page_items(spark, folder)
    even, odd = items.where("page_id % 2 = 0"), items.where("page_id % 2 = 1")
    models.score_batch(even, path, "even", valid=decodable())
    models.score_batch(even, path, "even", valid=decodable())
    try:
        models.score_batch(odd, path, "odd", valid=decodable(), on_error="raise")
    except ValueError:
        models.score_batch(odd, path, "odd", valid=decodable())
    return path


@query(
    "m7_score_batch",
    f"""WITH {PAGE_SQL} SELECT id, filename, 'suspeita' AS label, 0.71::DOUBLE AS score, true AS stamped,
         'storage/' || id || '.png' AS image_relpath FROM pages_scored WHERE good""",
)
def m7_batch(spark, folder):
    stamped = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    rows = models.scored_history(spark, scored_pages(spark, folder))
    return rows.select("id", "filename", "label", "score", stamped.alias("stamped"), "image_relpath")


@query(
    "q14_scoring_errors",
    f"""WITH {PAGE_SQL} SELECT e.batch, e.filename, e.code, e.message, l.scored, l.failed FROM (
         SELECT batch, filename, 'INVALID_INPUT' AS code, 'invalid file or unsupported format' AS message FROM pages_scored WHERE NOT good) e
       JOIN (SELECT batch, count(*) FILTER (good) AS scored, count(*) FILTER (NOT good) AS failed FROM pages_scored GROUP BY 1) l USING (batch)""",
)
def q14_batch(spark, folder):
    path = scored_pages(spark, folder)
    return models.scoring_errors(spark, path).drop("created_at").join(models.read_ledger(spark, path), "batch")


@query(
    "q14_input_errors",
    """SELECT url AS path, 'INVALID_INPUT' AS code, 'invalid file or unsupported format' AS message FROM pages
       WHERE NOT regexp_matches(regexp_replace(url, '[?#].*$', ''), '/[0-9]+$')""",
)
def q14(spark, folder):
    listed = v.table(spark, folder, "pages").select(F.col("url").alias("path"))
    stem = names.base_name(F.regexp_replace("path", "[?#].*$", ""))
    return models.input_errors(listed, listed.where(stem.rlike("^[0-9]+$")))
