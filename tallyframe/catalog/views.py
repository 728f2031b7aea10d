"""Dataset-shaped views of the shared tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.split import stratified_split
from tallyframe.sources.files import describe_paths

N_CLASSES = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(prefix: str, col: str, suffix: str = ""):
    return F.concat(F.lit(prefix), F.col(col).cast("string"), F.lit(suffix))


# -- manifest rows (documents) against files (labels) -----------------------
def manifest(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), _id("data/Doc_", "doc_id", ".jpg").alias("image"), "lang", "source", "n_chars"
    )


def manifest_images(spark, folder):
    return table(spark, folder, "labels").select(_id("img/doc_", "doc_id", ".JPG").alias("path"))


def manifest_masks(spark, folder):
    rows = table(spark, folder, "labels").where("quality = 1")
    return rows.select(_id("msk/doc_", "doc_id", "_segmentation.png").alias("path"))


V_MANIFEST = """v_manifest AS (
  SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, l.doc_id IS NOT NULL AS image_exists,
         coalesce(l.quality, 0) = 1 AS mask_exists
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


# -- label columns -----------------------------------------------------------
LANGS = ["en", "de", "fr", "es"]


def onehot(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), *[(F.col("lang") == c).cast("int").alias(c) for c in LANGS]
    )


V_ONEHOT = """v_onehot AS (
  SELECT doc_id AS id, CAST(lang = 'en' AS INT) AS en, CAST(lang = 'de' AS INT) AS de,
         CAST(lang = 'fr' AS INT) AS fr, CAST(lang = 'es' AS INT) AS es FROM documents)"""


def multi(spark, folder):
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


V_MULTI = "v_multi AS (SELECT doc_id AS id, quality, toxic FROM labels)"


# -- path text ---------------------------------------------------------------
def files(spark, folder):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, folder, "pages").select(F.col("page_id").alias("id"), path.alias("path")).withColumn(
        "name", F.regexp_extract("path", "([^/]*)$", 1)
    )


V_FILES = """v_files AS (
  SELECT page_id AS id, regexp_replace(url, '[?#].*$', '') AS path,
         regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages)"""


# -- image and mask stems ------------------------------------------------------
def alias(spark, folder):
    k, kind = _id("IMG_", "p_partkey"), F.col("p_partkey") % 5
    mask = (
        F.when(kind == 0, F.concat(k, F.lit("_segmentation")))
        .when(kind == 1, F.concat(F.lit("mask_"), k))
        .when(kind == 2, F.concat(k, F.lit("-seg")))
        .when(kind == 3, k)
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), k.alias("stem"), mask.alias("mask_stem"))


V_ALIAS = """v_alias AS (
  SELECT p_partkey AS id, 'IMG_' || p_partkey AS stem,
         CASE p_partkey % 5 WHEN 0 THEN 'IMG_' || p_partkey || '_segmentation'
                            WHEN 1 THEN 'mask_IMG_' || p_partkey
                            WHEN 2 THEN 'IMG_' || p_partkey || '-seg'
                            WHEN 3 THEN 'IMG_' || p_partkey END AS mask_stem
  FROM part)"""


def alias_images(spark, folder):
    return describe_paths(alias(spark, folder).select(F.concat(F.lit("img/"), "stem", F.lit(".jpg")).alias("path")))


def alias_masks(spark, folder):
    rows = alias(spark, folder).where(F.col("mask_stem").isNotNull())
    return describe_paths(rows.select(F.concat(F.lit("msk/"), "mask_stem", F.lit(".png")).alias("path")))


# -- many manifest rows per file: line items name parts --------------------------
def part_files(spark, folder):
    k, kind = _id("IMG_", "p_partkey"), F.col("p_partkey") % 4
    path = (
        F.when(kind == 0, F.concat(F.lit("img/"), k, F.lit(".jpg")))
        .when(kind == 1, F.concat(F.lit("img/sub/"), k, F.lit(".png")))
        .when(kind == 2, F.concat(F.lit("img/"), k, F.lit(".tif")))
        .otherwise(F.concat(F.lit("img/"), k, F.lit(".v1.jpg")))
    )
    return table(spark, folder, "part").select(path.alias("path"))


def part_rows(spark, folder):
    k, kind = F.col("l_partkey").cast("string"), (F.col("l_linenumber") + F.col("l_orderkey")) % 6
    value = (
        F.when(kind == 0, F.concat(F.lit("img/IMG_"), k, F.lit(".jpg")))
        .when(kind == 1, F.concat(F.lit(" IMG_"), k))
        .when(kind == 2, F.concat(F.lit("IMG_"), k, F.lit(".jpg")))
        .when(kind == 3, F.concat(F.lit("C:\\raw\\img_"), k, F.lit(".PNG")))
        .when(kind == 4, F.concat(F.lit("sub/IMG_"), k, F.lit(".png")))
        .otherwise(F.lit(""))
    )
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", value.alias("image"))


V_PARTS = r"""part_files AS (
  SELECT CASE p_partkey % 4 WHEN 0 THEN 'img/IMG_' || p_partkey || '.jpg'
                            WHEN 1 THEN 'img/sub/IMG_' || p_partkey || '.png'
                            WHEN 2 THEN 'img/IMG_' || p_partkey || '.tif'
                            ELSE 'img/IMG_' || p_partkey || '.v1.jpg' END AS path FROM part),
part_rows AS (
  SELECT l_orderkey, l_linenumber,
         CASE (l_linenumber + l_orderkey) % 6
           WHEN 0 THEN 'img/IMG_' || l_partkey || '.jpg' WHEN 1 THEN ' IMG_' || l_partkey
           WHEN 2 THEN 'IMG_' || l_partkey || '.jpg' WHEN 3 THEN 'C:\raw\img_' || l_partkey || '.PNG'
           WHEN 4 THEN 'sub/IMG_' || l_partkey || '.png' ELSE '' END AS image
  FROM lineitem)"""


# -- features, splits, predictions --------------------------------------------------
def features(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("target_index")
    )


V_FEATURES = """v_features AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label AS target_index FROM embeddings)"""


def split(spark, folder, with_x: bool = False):
    rows = features(spark, folder)
    rows = rows if with_x else rows.drop("x")
    return stratified_split(rows, "target_index", "id", allocate="per_class")


V_SPLIT = V_FEATURES + """, v_split AS (
  SELECT id, target_index,
         CASE WHEN rn * 100 <= n * 70 THEN 'train' WHEN rn * 100 <= n * 85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT id, target_index, count(*) OVER (PARTITION BY target_index) AS n,
               row_number() OVER (PARTITION BY target_index ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn
        FROM v_features))"""


def scored(spark, folder):
    y = F.col("target_index")
    return features(spark, folder).select(
        "id",
        y.alias("y_true"),
        F.when(F.col("id") % 3 == 0, (y + 1) % 9).otherwise(y % 9).cast("int").alias("y_pred"),
    )


V_SCORED = V_FEATURES + """, v_scored AS (
  SELECT id, target_index AS y_true,
         CASE WHEN id % 3 = 0 THEN (target_index + 1) % 9 ELSE target_index % 9 END AS y_pred FROM v_features),
v_counts AS (SELECT y_true, y_pred, count(*) AS n FROM v_scored GROUP BY 1, 2),
v_class AS (
  SELECT label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
    SELECT y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM v_counts
    UNION ALL SELECT y_pred, 0, 0, n FROM v_counts) GROUP BY 1),
v_f1 AS (
  SELECT label, tp, support, predicted,
         CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision_,
         CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall_,
         CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * CAST(tp AS DOUBLE) / (support + predicted) END AS f1_
  FROM v_class)"""


def logits(spark, folder):
    """The first ten places of a stored vector as class scores."""
    return features(spark, folder).select("id", "target_index", F.slice("x", 1, N_CLASSES).alias("logits"))


V_LOGITS = V_FEATURES + """, v_logits AS (
  SELECT id, target_index, unnest(list_slice(x, 1, 10)) AS v, unnest(range(10)) AS c FROM v_features),
v_norm AS (
  SELECT id, target_index, max(v) AS top, max(v) + ln(sum(exp(v - m))) AS lse, sum(v) AS total,
         max(CASE WHEN c = target_index THEN v END) AS own
  FROM (SELECT *, max(v) OVER (PARTITION BY id) AS m FROM v_logits) GROUP BY id, target_index)"""


# -- prediction history ---------------------------------------------------------------
def history(spark, folder):
    key = F.col("event_id").cast("string")
    return table(spark, folder, "events").select(
        key.alias("id"),
        F.concat(F.lit("f"), key, F.lit(".png")).alias("filename"),
        F.col("event_type").alias("label"),
        F.col("value").alias("score"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("store/"), key, F.lit(".png"))).alias("image_relpath"),
    )


def history_old(spark, folder):
    return history(spark, folder).withColumnRenamed("id", "prediction_id").drop("image_relpath")


V_HISTORY = """v_history AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'f' || event_id || '.png' AS filename, event_type AS label,
         value AS score, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE 'store/' || event_id || '.png' END AS image_relpath FROM events)"""


# -- experiment runs and epochs --------------------------------------------------------
def _mean4(cents: str):
    """Mean of values counted in hundredths, cut to four decimals in whole numbers."""
    scaled = F.sum(F.round(F.col(cents) * 100).cast("bigint")) * 100
    return (scaled - scaled % F.count(F.lit(1))) / F.count(F.lit(1)) / 10000


def runs(spark, folder):
    o, line = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    sums = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        _mean4("l_discount").alias("val_f1_macro"),
        _mean4("l_tax").alias("val_accuracy"),
        F.round(F.sum("l_quantity"), 2).alias("runtime_sec"),
    )
    return o.join(sums, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("experiment_id"),
        F.col("o_orderpriority").alias("family"),
        "val_f1_macro",
        "val_accuracy",
        "runtime_sec",
        F.when(F.col("runtime_sec").isNull(), F.concat(F.lit("no rows: "), "o_orderstatus")).alias("error"),
    )


# means in whole hundredths: a float mean on a rounding tie depends on the order of its sum
V_RUNS = """v_runs AS (
  SELECT o.o_orderkey AS experiment_id, o.o_orderpriority AS family, f AS val_f1_macro, a AS val_accuracy,
         s AS runtime_sec, CASE WHEN s IS NULL THEN 'no rows: ' || o.o_orderstatus END AS error
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) * 100 // count(*) AS DOUBLE) / 10000 AS f,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) * 100 // count(*) AS DOUBLE) / 10000 AS a,
           round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey)"""


def epochs(spark, folder):
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
        .agg(
            F.round(F.avg("value"), 6).alias("val_f1_macro"),
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("value"), 4).alias("seconds"),
        )
    )


V_EPOCHS = """v_epochs AS (
  SELECT event_type AS run, CAST(day(ts) AS INT) AS epoch, round(avg(value), 6) AS val_f1_macro,
         count(*) AS n, round(sum(value), 4) AS seconds
  FROM events GROUP BY 1, 2)"""


# -- pixels derived from the texts: 4 x 4 RGB from two digests ---------------------------
def pixels(spark, folder):
    text = F.concat(F.sha2("text", 256), F.sha2(F.concat("text", F.lit("#")), 256))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.unhex(F.substring(text, 1, 96)).alias("data"),
        F.lit(4).alias("height"),
        F.lit(4).alias("width"),
    )


V_PIXELS = """v_hex AS (SELECT doc_id AS id, sha256(text) || sha256(text || '#') AS h FROM documents),
v_pixels AS (
  SELECT id, i, i % 3 AS c, i // 3 AS p, CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INT) AS v
  FROM v_hex, range(48) r(i))"""
