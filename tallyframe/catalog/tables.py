"""Profiling, contract, split, weight, metric and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import views as v
from tallyframe.catalog.registry import query
from tallyframe.functions import scores, values
from tallyframe.operators import contract, features, items, metrics, profile, resolve, runs, split, weights
from tallyframe.plans.pages import page_by_keys
from tallyframe.sources import history as hist


def r6(df, *cols):
    """The frame with the given columns rounded to six digits."""
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


# -- profiling ---------------------------------------------------------------------------------
@query(
    "a1_summary",
    f"""WITH {v.V_ALIAS} SELECT (SELECT count(DISTINCT stem) FROM v_alias) AS num_images,
        (SELECT count(DISTINCT mask_stem) FROM v_alias) AS num_masks, (SELECT count(*) FROM documents) AS csv_rows""",
)
def a1(spark, folder):
    records = v.table(spark, folder, "documents")
    return items.summary(v.alias_images(spark, folder), v.alias_masks(spark, folder), records)


def holed(spark, folder):
    docs = v.table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        F.nullif(F.col("lang"), F.lit("en")).alias("lang"),
        F.nullif(F.col("source"), F.lit("src3")).alias("source"),
        F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise("")).alias("image"),
        F.when(F.col("n_chars") % 2 == 0, "1").when(F.col("n_chars") % 3 == 0, "0").otherwise("n/a").alias("seg_flag"),
    )


V_HOLED = """v_holed AS (SELECT doc_id, nullif(lang, 'en') AS lang, nullif(source, 'src3') AS source,
  'Doc_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '' END AS image,
  CASE WHEN n_chars % 2 = 0 THEN '1' WHEN n_chars % 3 = 0 THEN '0' ELSE 'n/a' END AS seg_flag FROM documents)"""


@query(
    "a2_missingness",
    f"""WITH {V_HOLED}, m AS (SELECT avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END) AS lang,
          avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END) AS source FROM v_holed)
        SELECT unnest(['lang', 'source', 'doc_id', 'image', 'seg_flag']) AS column,
               round(unnest([lang * 100, source * 100, 0.0, 0.0, 0.0]), 6) AS missing_pct FROM m""",
)
def a2(spark, folder):
    return r6(profile.missingness(holed(spark, folder)), "missing_pct")


@query(
    "a3_filename_scores",
    f"""WITH {V_HOLED}, s AS (SELECT avg(CASE WHEN ends_with(image, '.png') THEN 1.0 ELSE 0 END) AS sc FROM v_holed)
        SELECT 'image' AS kind, 'image' AS column, round(sc, 6) AS score FROM s
        UNION ALL SELECT 'mask', 'image', round(sc, 6) FROM s UNION ALL SELECT 'mask', 'seg_flag', 0.15""",
)
def a3(spark, folder):
    df = holed(spark, folder)
    image = profile.filename_scores(df).select(F.lit("image").alias("kind"), "column", "score")
    mask = profile.filename_scores(df, mask=True).select(F.lit("mask").alias("kind"), "column", "score")
    return r6(image.unionByName(mask), "score")


@query(
    "a4_infer_key_column",
    f"""WITH {V_HOLED} SELECT 'image' AS column, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS stem_match_ratio,
          count(DISTINCT image) AS nunique, 0.0 AS missing_ratio FROM v_holed h LEFT JOIN labels l USING (doc_id)
        UNION ALL SELECT 'lang', 1.0, count(DISTINCT lang), round(avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END), 6) FROM v_holed
        WHERE (SELECT count(*) FROM labels) > 0""",
)
def a4(spark, folder):
    stems = v.table(spark, folder, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("stem"))
    langs = v.table(spark, folder, "documents").select(F.col("lang").alias("stem"))
    found = profile.infer_key_column(holed(spark, folder), stems.unionByName(langs), ["lang", "source", "image", "seg_flag"])
    return r6(found, "stem_match_ratio", "missing_ratio")


@query(
    "a5_binary_columns",
    f"""WITH {v.V_MULTI} SELECT 'id' AS column, bool_and(id IN (0, 1)) AS binary_like FROM v_multi
        UNION ALL SELECT 'quality', bool_and(quality IN (0, 1)) FROM v_multi
        UNION ALL SELECT 'toxic', bool_and(toxic IN (0, 1)) FROM v_multi
        UNION ALL SELECT 'seg_flag', true""",
)
def a5(spark, folder):
    found = profile.binary_columns(v.multi(spark, folder))
    return found.unionByName(profile.binary_columns(holed(spark, folder).select("seg_flag")))


@query(
    "a2_a5_column_facts",
    f"""WITH {V_HOLED} SELECT 'image' AS column, 0.0 AS missing_pct,
          round(avg(CASE WHEN ends_with(image, '.png') THEN 1.0 ELSE 0 END), 6) AS filename_share, 0.0 AS numeric_share, false AS binary_like
        FROM v_holed UNION ALL
        SELECT 'seg_flag', 0.0, 0.0, round(avg(CASE WHEN seg_flag <> 'n/a' THEN 1.0 ELSE 0 END), 6), true FROM v_holed UNION ALL
        SELECT 'lang', round(avg(CASE WHEN lang IS NULL THEN 100.0 ELSE 0 END), 6), 0.0, 0.0, false FROM v_holed""",
)
def column_facts(spark, folder):
    facts = profile.column_facts(holed(spark, folder), ["image", "seg_flag", "lang"]).drop("ordinal")
    return r6(facts, "missing_pct", "filename_share", "numeric_share")


MODE_SQL = """SELECT '{0}' AS kind, round(a, 6) AS ratio_eq_1, round(b, 6) AS ratio_in_01,
  CASE WHEN a >= 0.9 AND b >= 0.98 THEN 'single_label' ELSE 'multi_label' END AS mode,
  CASE WHEN a >= 0.9 AND b >= 0.98 THEN 'one_hot_multiclass' ELSE 'multi_label_binary_cols' END AS target_encoding
  FROM (SELECT avg(CASE WHEN {1} = 1 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN {1} IN (0, 1) THEN 1.0 ELSE 0 END) AS b FROM {2})"""


@query(
    "a6_label_mode",
    f"WITH {v.V_ONEHOT}, {v.V_MULTI} {MODE_SQL.format('onehot', '(en + de + fr + es)', 'v_onehot')} UNION ALL "
    f"{MODE_SQL.format('multi', '(quality + toxic)', 'v_multi')}",
)
def a6(spark, folder):
    one = profile.infer_label_mode(v.onehot(spark, folder), v.LANGS).select(F.lit("onehot").alias("kind"), "*")
    many = profile.infer_label_mode(v.multi(spark, folder), ["quality", "toxic"]).select(F.lit("multi").alias("kind"), "*")
    return r6(one.unionByName(many), "ratio_eq_1", "ratio_in_01")


@query(
    "a7_row_sums",
    f"""WITH {v.V_MULTI} SELECT CAST(quality + toxic AS BIGINT) AS row_sum, count(*) AS rows,
        round((SELECT count(*) FILTER (quality + toxic <> 1) * 100.0 / count(*) FROM v_multi), 6) AS invalid_pct FROM v_multi GROUP BY 1""",
)
def a7(spark, folder):
    return r6(profile.one_hot_sanity(v.multi(spark, folder), ["quality", "toxic"]), "invalid_pct")


@query("a8_class_counts", "SELECT lang AS label, count(*) AS count FROM documents GROUP BY 1")
def a8(spark, folder):
    return profile.class_counts(v.onehot(spark, folder), v.LANGS)


@query(
    "a9_positive_counts",
    f"""WITH {v.V_MULTI} SELECT 'quality' AS label, count(*) FILTER (quality = 1) AS positives FROM v_multi
        UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1) FROM v_multi""",
)
def a9(spark, folder):
    return profile.positive_counts(v.multi(spark, folder), ["quality", "toxic"])


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe_sql(col: str) -> str:
    c = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{col}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem"""


@query("a10_describe_numeric", " UNION ALL ".join(describe_sql(c) for c in NUMERIC))
def a10(spark, folder):
    return r6(profile.describe_numeric(v.table(spark, folder, "lineitem"), NUMERIC), "mean", "std", "p25", "p50", "p75")


@query(
    "a11_value_counts",
    f"""WITH {V_HOLED} SELECT coalesce(source, 'nan') AS value, count(*) AS count FROM v_holed GROUP BY 1
        ORDER BY count DESC, value LIMIT 15""",
)
def a11(spark, folder):
    return profile.value_counts(holed(spark, folder), "source")


@query(
    "a12_duplicates",
    """SELECT 'text' AS key, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, count(*) AS groups FROM (SELECT count(*) AS n FROM documents
         GROUP BY text HAVING count(*) > 1)
       UNION ALL SELECT 'line', coalesce(sum(n), 0)::BIGINT, count(*) FROM (SELECT count(*) AS n FROM lineitem
         GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def a12(spark, folder):
    text = profile.duplicates(v.table(spark, folder, "documents"), resolve.text_key("text"))
    line = profile.duplicates(v.table(spark, folder, "lineitem"), F.struct("l_orderkey", "l_linenumber"))
    return text.select(F.lit("text").alias("key"), "*").unionByName(line.select(F.lit("line").alias("key"), "*"))


def split_labels(spark, folder):
    langs = [(F.col("target_index") == i).cast("double").alias(f"c{i}") for i in range(v.N_CLASSES)]
    # every seventh row gets a second label, so that sums are not all 1
    return v.split(spark, folder).select("id", "split", *langs).withColumn(
        "c0", F.when(F.col("id") % 7 == 0, 1.0).otherwise(F.col("c0"))
    )


@query(
    "a15_one_hot_integrity",
    f"""WITH {v.V_SPLIT}, s AS (SELECT split, 1 + CASE WHEN id % 7 = 0 AND target_index <> 0 THEN 1 ELSE 0 END AS total FROM v_split)
        SELECT split, count(*) AS n_rows, count(*) FILTER (total <> 1) AS n_bad_sum,
          round(count(*) FILTER (total <> 1) / count(*), 6) AS bad_sum_ratio, 0.0::DOUBLE AS min_label_val, 1.0::DOUBLE AS max_label_val,
          0.001::DOUBLE AS atol, 'filter' AS policy, count(*) FILTER (total = 1) AS n_rows_after_policy, true AS in_range
        FROM s GROUP BY split""",
)
def a15(spark, folder):
    labels = [f"c{i}" for i in range(v.N_CLASSES)]
    return r6(contract.one_hot_integrity(split_labels(spark, folder), labels, policy="filter"), "bad_sum_ratio")


# -- classes and weights -------------------------------------------------------------------------
@query(
    "a16_class_distribution",
    f"""WITH {v.V_FEATURES} SELECT CAST(i AS INT) AS target_index, count(id) AS rows FROM range(12) r(i)
        LEFT JOIN v_features ON target_index = i GROUP BY 1""",
)
def a16(spark, folder):
    return weights.class_distribution(v.features(spark, folder), 12)


@query(
    "a17_majority_baseline",
    f"""WITH {v.V_SPLIT}, m AS (SELECT target_index FROM v_split WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT split, round(avg(CASE WHEN v.target_index = m.target_index THEN 1.0 ELSE 0 END), 6) AS accuracy
        FROM v_split v, m WHERE split <> 'train' GROUP BY 1""",
)
def a17(spark, folder):
    rows = v.split(spark, folder)
    scored = metrics.majority_baseline(rows.where("split = 'train'"), rows.where("split <> 'train'"))
    hit = (F.col("target_index") == F.col("y_pred")).cast("double")
    return r6(scored.groupBy("split").agg(F.avg(hit).alias("accuracy")), "accuracy")


@query("a18_accuracy", f"WITH {v.V_SCORED} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM v_scored")
def a18(spark, folder):
    return r6(metrics.accuracy(v.scored(spark, folder)), "accuracy")


@query("a19_f1_macro", f"WITH {v.V_SCORED} SELECT round(avg(f1_), 6) AS f1_macro FROM v_f1")
def a19(spark, folder):
    return r6(metrics.f1_macro(v.scored(spark, folder)), "f1_macro")


@query(
    "a20_confusion_wide",
    f"""WITH {v.V_SCORED} SELECT CAST(a.i AS INT) AS y_true,
        {', '.join(f'coalesce(sum(n) FILTER (y_pred = {i}), 0)::BIGINT AS "{i}"' for i in range(10))}
        FROM range(10) a(i) LEFT JOIN v_counts ON y_true = a.i GROUP BY 1""",
)
def a20(spark, folder):
    return metrics.confusion_wide(v.scored(spark, folder), v.N_CLASSES)


@query(
    "a21_confusion_shares",
    f"""WITH {v.V_SCORED}, g AS (SELECT CAST(a.i AS INT) AS y_true, CAST(b.i AS INT) AS y_pred, coalesce(n, 0) AS n
          FROM range(11) a(i), range(11) b(i) LEFT JOIN v_counts ON v_counts.y_true = a.i AND v_counts.y_pred = b.i)
        SELECT y_true, y_pred, n, round(n / greatest(sum(n) OVER (PARTITION BY y_true), 1e-9), 6) AS share FROM g""",
)
def a21(spark, folder):
    return r6(metrics.confusion_matrix(v.scored(spark, folder), 11, normalize=True), "share")


@query(
    "a22_classification_report",
    f"""WITH {v.V_SCORED}, t AS (SELECT sum(support) AS s FROM v_f1)
        SELECT 'class ' || label AS name, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1_, 6) AS f1,
               support::BIGINT AS support FROM v_f1
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM v_f1
        UNION ALL SELECT 'macro avg', round(avg(precision_), 6), round(avg(recall_), 6), round(avg(f1_), 6), sum(support)::BIGINT FROM v_f1
        UNION ALL SELECT 'weighted avg', round(sum(precision_ * support) / sum(support), 6), round(sum(recall_ * support) / sum(support), 6),
               round(sum(f1_ * support) / sum(support), 6), sum(support)::BIGINT FROM v_f1""",
)
def a22(spark, folder):
    names = {i: f"class {i}" for i in range(v.N_CLASSES)}
    return r6(metrics.classification_report(v.scored(spark, folder), names), "precision", "recall", "f1")


@query(
    "a23_balanced_weights",
    f"""WITH {v.V_FEATURES} SELECT target_index, count(*) AS rows,
        round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM v_features GROUP BY 1""",
)
def a23(spark, folder):
    return r6(weights.balanced_weights(v.features(spark, folder)), "weight")


MEAN_ONE_SQL = """dist AS (SELECT CAST(i AS INT) AS target_index, count(id) AS rows FROM range(12) r(i)
    LEFT JOIN v_features ON target_index = i GROUP BY 1),
  raw AS (SELECT *, CAST(sum(rows) OVER () AS DOUBLE) / (12 * greatest(rows, 1)) AS r FROM dist),
  mean_one AS (SELECT target_index, rows, r / avg(r) OVER () AS weight FROM raw)"""


@query("a24_mean_one_weights", f"WITH {v.V_FEATURES}, {MEAN_ONE_SQL} SELECT target_index, rows, round(weight, 6) AS weight FROM mean_one")
def a24(spark, folder):
    return r6(weights.mean_one_weights(v.features(spark, folder), 12), "weight")


@query(
    "l7_weighted_sample",
    f"""WITH {v.V_FEATURES}, {MEAN_ONE_SQL},
        l AS (SELECT id, CAST(round(weight * (SELECT pow(2, floor(46 - log2(sum(weight)))) FROM v_features JOIN mean_one USING (target_index))) AS BIGINT) AS len, md5('42:' || id) AS h FROM v_features JOIN mean_one USING (target_index)),
        p AS (SELECT id, sum(len) OVER (ORDER BY h, id) AS upto, len FROM l),
        t AS (SELECT sum(len)::BIGINT AS total, count(*) AS n FROM l),
        d AS (SELECT i AS draw, CAST('0x' || substr(md5('42:draw:' || i), 1, 15) AS BIGINT) % total AS pt FROM t, range((SELECT count(*) FROM v_features)) r(i))
        SELECT draw, id FROM d JOIN p ON pt >= upto - len AND pt < upto""",
)
def l7(spark, folder):
    rows = v.features(spark, folder).select("id", "target_index")
    weighted = weights.attach_weights(rows, weights.mean_one_weights(rows, 12), 12)
    return weights.weighted_sample(weighted, "weight", "id", rows.count())


# -- metrics on scores ------------------------------------------------------------------------------
@query(
    "m8_evaluate_logits",
    f"""WITH {v.V_LOGITS}, s AS (SELECT id, target_index AS y_true, CAST(arg_min(c, -v) AS INT) AS y_pred FROM v_logits GROUP BY 1, 2),
        f AS (SELECT label, 2.0 * sum(tp) / (sum(a) + sum(b)) AS f1, sum(tp) AS tp, sum(a) AS a FROM (
          SELECT y_true AS label, (y_true = y_pred)::INT AS tp, 1 AS a, 0 AS b FROM s UNION ALL SELECT y_pred, 0, 0, 1 FROM s) GROUP BY 1)
        SELECT sum(a)::BIGINT AS rows, round(sum(tp) / sum(a), 6) AS accuracy, round(avg(f1), 6) AS f1_macro FROM f""",
)
def m8(spark, folder):
    return r6(metrics.evaluate_logits(v.logits(spark, folder)), "accuracy", "f1_macro")


CLASS_W = [0.5, 1.0, 1.5, 2.0, 0.25, 1.0, 1.0, 3.0, 0.75, 1.25]
W_SQL = "[" + ", ".join(str(w) for w in CLASS_W) + "]"


@query(
    "m9_cross_entropy",
    f"""WITH {v.V_LOGITS}, w AS (SELECT id, sum(({W_SQL}[c + 1]) * (lse - v)) AS wspread FROM v_logits JOIN v_norm USING (id, target_index) GROUP BY id)
        SELECT round(avg(0.9 * (lse - own) + 0.01 * (10 * lse - total)), 6) AS smoothed,
               round(sum({W_SQL}[target_index + 1] * 0.9 * (lse - own) + 0.01 * wspread) / sum({W_SQL}[target_index + 1]), 6) AS weighted
        FROM v_norm JOIN w USING (id)""",
)
def m9(spark, folder):
    df = v.logits(spark, folder)
    return r6(
        df.agg(
            scores.cross_entropy("logits", "target_index", v.N_CLASSES, 0.1).alias("smoothed"),
            scores.cross_entropy("logits", "target_index", v.N_CLASSES, 0.1, CLASS_W).alias("weighted"),
        ),
        "smoothed",
        "weighted",
    )


@query(
    "m10_focal_loss",
    f"""WITH {v.V_LOGITS} SELECT round(avg(-power(1 - exp(own - lse), 2) * (own - lse)), 6) AS plain,
        round(avg(-power(1 - exp(own - lse), 2) * (own - lse) * {W_SQL}[target_index + 1]), 6) AS weighted FROM v_norm""",
)
def m10(spark, folder):
    df = v.logits(spark, folder)
    return r6(
        df.agg(
            scores.focal_loss("logits", "target_index").alias("plain"),
            scores.focal_loss("logits", "target_index", 2.0, CLASS_W).alias("weighted"),
        ),
        "plain",
        "weighted",
    )


GRID = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


@query(
    "q15_temperature",
    f"""WITH {v.V_FEATURES}, l AS (SELECT id, target_index, unnest(list_slice(x, 1, 10)) AS v, unnest(range(10)) AS c FROM v_features),
        t AS (SELECT unnest({GRID}) AS temperature),
        n AS (SELECT temperature, id, ln(sum(exp(v / temperature))) - max(CASE WHEN c = target_index THEN v / temperature END) AS nll
              FROM l, t GROUP BY 1, 2)
        SELECT temperature::DOUBLE AS temperature, round(avg(nll), 6) AS loss FROM n GROUP BY 1""",
)
def q15(spark, folder):
    fitted = metrics.fit_temperature(v.logits(spark, folder), v.N_CLASSES, GRID)
    return r6(fitted, "loss")


PROBS_SQL = f"""{v.V_LOGITS}, probs AS (SELECT id, target_index, c, exp(v - lse) AS p FROM v_logits JOIN v_norm USING (id, target_index)),
  facts AS (SELECT id, target_index AS y_true, CAST(arg_min(c, -p) AS INT) AS y_pred, max(p) AS confidence, -sum(p * ln(p)) AS entropy,
            max(p) - max(p, 2)[2] AS margin FROM probs GROUP BY 1, 2)"""


def with_probs(spark, folder):
    df = metrics.with_probabilities(v.logits(spark, folder))
    return df.select("id", F.col("target_index").alias("y_true"), values.argmax("probability").alias("y_pred"), "probability")


@query(
    "q7_error_analysis",
    f"""WITH {PROBS_SQL}, wrong AS (SELECT 'wrong' AS kind, * FROM facts WHERE y_true <> y_pred ORDER BY confidence DESC, id LIMIT 25),
        unsure AS (SELECT 'uncertain' AS kind, * FROM facts ORDER BY entropy DESC, id LIMIT 25)
        SELECT kind, id, y_true, y_pred, round(confidence, 6) AS confidence, round(entropy, 6) AS entropy, round(margin, 6) AS margin
        FROM (FROM wrong UNION ALL FROM unsure)""",
)
def q7(spark, folder):
    scored = with_probs(spark, folder)
    parts = [
        metrics.error_analysis(scored, "probability", 25, "id", by=by).select(F.lit(by).alias("kind"), "*").drop("probability")
        for by in ("wrong", "uncertain")
    ]
    return r6(parts[0].unionByName(parts[1]), "confidence", "entropy", "margin")


@query(
    "q8_top_k_labels",
    f"""WITH {PROBS_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY p DESC, c) AS INT) AS place, CAST(c AS INT) AS label,
        round(p, 6) AS score FROM probs QUALIFY place <= 3""",
)
def q8(spark, folder):
    return r6(metrics.top_k_labels(with_probs(spark, folder), "probability", 3, "id"), "score")


@query(
    "q9_mask_metrics",
    f"""WITH {v.V_FEATURES}, e AS (SELECT id, unnest(x) AS v FROM v_features),
        s AS (SELECT id, count(*) FILTER (v > 0) AS p, count(*) FILTER (v > 0.05 OR v < -0.2) AS t,
              count(*) FILTER (v > 0.05) AS i FROM e GROUP BY id)
        SELECT id, round(CASE WHEN p + t = i THEN 1.0 ELSE i / (p + t - i) END, 6) AS iou,
               round(CASE WHEN p + t = 0 THEN 1.0 ELSE 2 * i / (p + t) END, 6) AS dice FROM s""",
)
def q9(spark, folder):
    truth = F.transform("x", lambda a: ((a > 0.05) | (a < -0.2)).cast("int"))
    masks = v.features(spark, folder).select("id", values.binarize("x").alias("pred"), truth.alias("truth"))
    return r6(metrics.mask_metrics(masks, "pred", "truth").select("id", "iou", "dice"), "iou", "dice")


@query(
    "q9_mask_means",
    f"""WITH {v.V_FEATURES}, e AS (SELECT id, unnest(x) AS v FROM v_features),
        s AS (SELECT id, count(*) FILTER (v > 0) AS p, count(*) FILTER (v > 0.05 OR v < -0.2) AS t,
              count(*) FILTER (v > 0.05) AS i FROM e GROUP BY id)
        SELECT count(*) AS rows, round(avg(CASE WHEN p + t = i THEN 1.0 ELSE i / (p + t - i) END), 6) AS iou_mean,
               round(avg(CASE WHEN p + t = 0 THEN 1.0 ELSE 2 * i / (p + t) END), 6) AS dice_mean FROM s""",
)
def q9_means(spark, folder):
    truth = F.transform("x", lambda a: ((a > 0.05) | (a < -0.2)).cast("int"))
    masks = v.features(spark, folder).select("id", values.binarize("x").alias("pred"), truth.alias("truth"))
    return r6(metrics.mask_means(metrics.mask_metrics(masks, "pred", "truth")), "iou_mean", "dice_mean")


@query(
    "q10_mask_area",
    f"WITH {v.V_FEATURES} SELECT id, round(list_sum([CASE WHEN e > 0 THEN 1 ELSE 0 END FOR e IN x]) / len(x), 6) AS area FROM v_features",
)
def q10(spark, folder):
    return v.features(spark, folder).select("id", F.round(metrics.mask_area_ratio(values.binarize("x")), 6).alias("area"))


# -- splits -------------------------------------------------------------------------------------------
@query("q2_stratified_split", f"WITH {v.V_SPLIT} SELECT id, target_index, split FROM v_split")
def q2(spark, folder):
    return v.split(spark, folder)


REMAINDER_SQL = """n AS (SELECT s, count(*) AS n FROM rows_ GROUP BY s),
  b AS (SELECT s, n, n * 15 // 100 AS v0, n * 15 % 100 AS rem, sum(n) OVER () * 15 // 100 - sum(n * 15 // 100) OVER () AS lack FROM n),
  v AS (SELECT *, v0 + CASE WHEN row_number() OVER (ORDER BY n > 2 * v0 DESC, rem DESC, s) <= lack THEN 1 ELSE 0 END AS val FROM b),
  t AS (SELECT *, v0 + CASE WHEN row_number() OVER (ORDER BY n > val + v0 DESC, rem DESC, s) <= lack THEN 1 ELSE 0 END AS test FROM v),
  k AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || id), id) AS rn FROM rows_)
  SELECT id, CASE WHEN rn <= n - val - test THEN 'train' WHEN rn <= n - test THEN 'val' ELSE 'test' END AS split FROM k JOIN t USING (s)"""


@query("q2_largest_remainder_split", f"WITH rows_ AS (SELECT doc_id AS id, source AS s FROM documents), {REMAINDER_SQL}")
def q2_remainder(spark, folder):
    docs = v.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source")
    return split.stratified_split(docs, "source", "id").select("id", "split")


@query(
    "q3_multilabel_split",
    f"""WITH rows_ AS (SELECT doc_id AS id, concat_ws('|', CASE WHEN quality = 1 THEN 'quality' END,
        CASE WHEN toxic = 1 THEN 'toxic' END) AS s FROM labels), {REMAINDER_SQL}""",
)
def q3(spark, folder):
    return split.multilabel_split(v.multi(spark, folder), ["quality", "toxic"], "id").select("id", "split")


@query(
    "q4_group_split",
    """SELECT event_id, user_id, CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'val' ELSE 'test' END AS split
       FROM (SELECT event_id, user_id, CAST('0x' || substr(md5('42:' || user_id), 1, 8) AS BIGINT) % 100 AS p FROM events)""",
)
def q4(spark, folder):
    return split.group_split(v.table(spark, folder, "events").select("event_id", "user_id"), "user_id")


@query(
    "q5_split_distribution",
    f"""WITH {v.V_SPLIT} SELECT split, target_index, count(*) AS rows,
        round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM v_split GROUP BY 1, 2""",
)
def q5(spark, folder):
    return r6(split.split_distribution(v.split(spark, folder), "target_index"), "share")


@query(
    "q5_split_missingness",
    f"""WITH {V_HOLED}, s AS (SELECT *, CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) % 100 AS p FROM v_holed),
        n AS (SELECT CASE WHEN p < 70 THEN 'train' WHEN p < 85 THEN 'val' ELSE 'test' END AS split, lang, source FROM s)
        SELECT split, 'lang' AS column, round(avg(CASE WHEN lang IS NULL THEN 100.0 ELSE 0 END), 6) AS missing_pct FROM n GROUP BY 1
        UNION ALL SELECT split, 'source', round(avg(CASE WHEN source IS NULL THEN 100.0 ELSE 0 END), 6) FROM n GROUP BY 1""",
)
def q5_missing(spark, folder):
    rows = split.group_split(holed(spark, folder), "doc_id")
    return r6(split.split_missingness(rows, ["lang", "source"]), "missing_pct")


@query(
    "q6_rare_policy",
    """SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) < (SELECT count(*) FROM documents) // 8 THEN 'other' ELSE lang END AS lang
       FROM documents""",
)
def q6(spark, folder):
    docs = v.table(spark, folder, "documents").select("doc_id", "lang")
    return split.rare_policy(docs, "lang", docs.count() // 8, ["doc_id"])


@query(
    "q12_validate_inputs",
    """SELECT p_partkey, concat_ws('|', CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'TYPE' END,
         CASE WHEN p_size NOT BETWEEN 5 AND 40 THEN 'SIZE' END, CASE WHEN nullif(p_brand, 'Brand#2') IS NULL THEN 'BRAND' END) AS violations,
         p_type IN ('ECONOMY', 'SMALL') AND p_size BETWEEN 5 AND 40 AND p_brand <> 'Brand#2' AS valid FROM part""",
)
def q12(spark, folder):
    rows = v.table(spark, folder, "part").withColumn("brand", F.nullif(F.col("p_brand"), F.lit("Brand#2")))
    rules = [
        (contract.enum_rule("p_type", ["ECONOMY", "SMALL"]), "TYPE"),
        (contract.range_rule("p_size", 5, 40), "SIZE"),
        (contract.required_rule("brand"), "BRAND"),
    ]
    return contract.validate(rows, rules).select("p_partkey", "violations", "valid")


@query(
    "q13_risk_level",
    """SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount * 10 < 0.32 THEN 'BAIXO_RISCO' WHEN l_discount * 10 < 0.65 THEN 'INCERTO'
       ELSE 'ALTO_RISCO' END AS risk FROM lineitem""",
)
def q13(spark, folder):
    risk = values.risk_level(F.col("l_discount") * 10, 0.32, 0.65)
    return v.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", risk.alias("risk"))


# -- runs --------------------------------------------------------------------------------------------------
@query("a25_error_counts", f"WITH {v.V_RUNS} SELECT error, count(*) AS runs FROM v_runs WHERE error IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a25(spark, folder):
    return runs.error_counts(v.runs(spark, folder))


@query(
    "a29_weighted_mean",
    f"WITH {v.V_EPOCHS} SELECT run, round(sum(val_f1_macro * n) / sum(n), 6) AS epoch_loss FROM v_epochs GROUP BY 1",
)
def a29(spark, folder):
    return r6(runs.weighted_mean(v.epochs(spark, folder), "val_f1_macro", "n", ["run"], "epoch_loss"), "epoch_loss")


EARLY_SQL = """e AS (SELECT run, epoch, val_f1_macro AS f, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM v_epochs),
  fold AS (
    SELECT run, i, CAST(epoch AS BIGINT) AS epoch, greatest(f, -1.0) AS best, CAST(CASE WHEN f > -1.0 + 1e-6 THEN epoch ELSE -1 END AS BIGINT) AS best_epoch,
           CASE WHEN f > -1.0 + 1e-6 THEN 0 ELSE 1 END AS bad FROM e WHERE i = 1
    UNION ALL
    SELECT e.run, e.i, CAST(e.epoch AS BIGINT), CASE WHEN f > best + 1e-6 THEN f ELSE best END,
           CASE WHEN f > best + 1e-6 THEN CAST(e.epoch AS BIGINT) ELSE best_epoch END, CASE WHEN f > best + 1e-6 THEN 0 ELSE bad + 1 END
    FROM fold JOIN e ON e.run = fold.run AND e.i = fold.i + 1 WHERE bad < 3),
  folded AS (SELECT run, arg_max(best_epoch, i) AS best_epoch, arg_max(best, i) AS best_value, max(epoch) AS epochs_ran,
                    arg_max(bad, i) >= 3 AS stopped_early FROM fold GROUP BY run)"""


@query("w6_early_stop", f"WITH RECURSIVE {v.V_EPOCHS}, {EARLY_SQL} SELECT run, best_epoch, best_value, epochs_ran, stopped_early FROM folded")
def w6(spark, folder):
    return runs.early_stop(v.epochs(spark, folder))


@query("a30_run_summary", f"WITH RECURSIVE {v.V_EPOCHS}, {EARLY_SQL} SELECT run, epochs_ran, best_epoch, best_value FROM folded")
def a30(spark, folder):
    return runs.run_summary(v.epochs(spark, folder))


@query(
    "a31_throughput",
    f"""WITH {v.V_EPOCHS} SELECT run, round(avg(seconds), 6) AS mean_epoch_sec, round(sum(n) / greatest(sum(seconds), 1e-9), 6) AS rows_per_sec
        FROM v_epochs GROUP BY 1""",
)
def a31(spark, folder):
    return r6(runs.throughput(v.epochs(spark, folder)), "mean_epoch_sec", "rows_per_sec")


@query(
    "w4_rank_runs",
    f"""WITH {v.V_RUNS} SELECT experiment_id, val_f1_macro, CASE WHEN val_f1_macro IS NOT NULL THEN
        rank() OVER (ORDER BY val_f1_macro DESC NULLS LAST) END AS rank_f1 FROM v_runs""",
)
def w4(spark, folder):
    return runs.rank_runs(v.runs(spark, folder)).select("experiment_id", "val_f1_macro", "rank_f1")


RUN_ORDER = "val_f1_macro DESC NULLS LAST, val_accuracy DESC NULLS LAST, runtime_sec ASC NULLS LAST, experiment_id"


@query("w5_select_best", f"WITH {v.V_RUNS} SELECT * FROM v_runs WHERE val_f1_macro IS NOT NULL ORDER BY {RUN_ORDER} LIMIT 1")
def w5(spark, folder):
    return runs.select_best(v.runs(spark, folder))


@query(
    "w7_eta",
    f"""WITH {v.V_EPOCHS}, a AS (SELECT *, avg(seconds) OVER (PARTITION BY run ORDER BY epoch) AS m FROM v_epochs)
        SELECT run, epoch, round(m, 6) AS avg_epoch_sec, round((40 - epoch) * m, 6) AS eta_sec FROM a""",
)
def w7(spark, folder):
    out = runs.eta(v.epochs(spark, folder), 40).select("run", "epoch", "avg_epoch_sec", "eta_sec")
    return r6(out, "avg_epoch_sec", "eta_sec")


@query("l4_sort_runs", f"WITH {v.V_RUNS} SELECT * FROM v_runs ORDER BY {RUN_ORDER}")
def l4(spark, folder):
    return runs.sort_runs(v.runs(spark, folder))


@query(
    "m11_selection",
    f"""WITH {v.V_RUNS} SELECT r.*, 'val_f1_macro, val_accuracy, runtime_sec' AS criterion,
          '{{"custkey":' || o_custkey || '}}' AS config
        FROM (SELECT * FROM v_runs WHERE val_f1_macro IS NOT NULL ORDER BY {RUN_ORDER} LIMIT 1) r JOIN orders ON o_orderkey = experiment_id""",
)
def m11(spark, folder):
    configs = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("experiment_id"), F.to_json(F.struct(F.col("o_custkey").alias("custkey"))).alias("config")
    )
    return runs.selection(v.runs(spark, folder), configs)


@query(
    "u3_collect_runs",
    f"""WITH {v.V_RUNS} SELECT experiment_id, val_f1_macro, NULL AS error FROM v_runs WHERE val_f1_macro IS NOT NULL
        UNION ALL SELECT experiment_id, NULL, error FROM v_runs WHERE val_f1_macro IS NULL""",
)
def u3(spark, folder):
    all_runs = v.runs(spark, folder)
    good = all_runs.where("val_f1_macro IS NOT NULL").select("experiment_id", "val_f1_macro")
    failed = all_runs.where("val_f1_macro IS NULL").select("experiment_id", "error")
    return runs.collect_runs([good, failed])


# -- pages and samples -----------------------------------------------------------------------------------------
@query("l1_sort_ids", "SELECT c_name, c_custkey FROM customer")
def l1(spark, folder):
    return items.sort_ids(v.table(spark, folder, "customer").select("c_name", "c_custkey"), "c_name")


@query(
    "l2_page",
    """SELECT c_name, (SELECT count(*) FROM customer WHERE contains(lower(c_name), '7')) AS total,
         70 < (SELECT count(*) FROM customer WHERE contains(lower(c_name), '7')) AS has_more
       FROM customer WHERE contains(lower(c_name), '7') ORDER BY lower(c_name), c_name LIMIT 24 OFFSET 46""",
)
def l2(spark, folder):
    found = items.search(v.table(spark, folder, "customer").select("c_name"), "7", "c_name")
    return items.page(found, 24, 46, "c_name")


@query("l3_history_page", f"WITH {v.V_HISTORY} SELECT * FROM v_history ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def l3(spark, folder):
    return hist.history_page(v.history(spark, folder), 20, 40)


@query(
    "l3_deep_page",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50
       OFFSET (SELECT CAST(count(*) * 2 // 3 AS BIGINT) FROM lineitem)""",
)
def l3_deep(spark, folder):
    lines = v.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True)]
    return page_by_keys(lines, order, lines.count() * 2 // 3, 50, shallow=1000)


@query("l5_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def l5(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return split.top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("l6_seeded_sample", "SELECT event_id, event_type FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 400")
def l6(spark, folder):
    return split.sample_n(v.table(spark, folder, "events").select("event_id", "event_type"), 400, 42, "event_id")


@query("l8_latest", f"WITH {v.V_HISTORY} SELECT id, filename, label, score, created_at FROM v_history ORDER BY created_at DESC, id LIMIT 200")
def l8(spark, folder):
    return hist.latest(v.history(spark, folder)).drop("image_relpath")


@query(
    "l10_check_paths",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 250) d
       WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 8""",
)
def l10(spark, folder):
    docs = v.table(spark, folder, "documents").select("doc_id", "lang")
    return resolve.check_paths(docs, v.table(spark, folder, "labels"), "doc_id", ["doc_id"])


@query("a28_total_rows", "SELECT count(*) AS total FROM events")
def a28(spark, folder):
    return items.total_rows(v.table(spark, folder, "events"))


# -- vector features -------------------------------------------------------------------------------------------
@query(
    "a27_vector_features",
    f"""WITH {v.V_FEATURES}, e AS (SELECT id, unnest(x) AS v FROM v_features),
        n AS (SELECT id, least(CAST(floor((v + 0.4) / 0.05) AS INT), 15) AS b FROM e WHERE v >= -0.4 AND v <= 0.4),
        h AS (SELECT f.id, CAST(r.i AS INT) AS place, count(n.b) / ((SELECT count(*) FROM n m WHERE m.id = f.id) * 0.05) AS value
              FROM v_features f JOIN range(16) r(i) ON true LEFT JOIN n ON n.id = f.id AND n.b = r.i GROUP BY f.id, r.i),
        s AS (SELECT id, 16 AS place, avg(v) AS value FROM e GROUP BY id UNION ALL SELECT id, 17, stddev_pop(v) FROM e GROUP BY id)
        SELECT id, place, round(value, 6) AS value FROM (FROM h UNION ALL FROM s)""",
)
def a27(spark, folder):
    out = features.vector_features(v.features(spark, folder), "x", 16, -0.4, 0.4)
    return r6(out.select("id", F.posexplode("features").alias("place", "value")), "value")


@query(
    "m1_standardize",
    f"""WITH {v.V_FEATURES}, e AS (SELECT id, unnest(x) AS v, CAST(unnest(range(64)) AS INT) AS place FROM v_features)
        SELECT id, place, round((v - avg(v) OVER w) / stddev_pop(v) OVER w, 6) AS z FROM e WINDOW w AS (PARTITION BY place)""",
)
def m1(spark, folder):
    out = features.standardize(v.features(spark, folder))
    return r6(out.select("id", F.posexplode("z").alias("place", "z")), "z")


@query(
    "a26_image_features",
    f"""WITH {v.V_PIXELS}, h AS (SELECT x.id, CAST(c.c * 16 + b.b AS INT) AS place, CAST(count(p.v) AS DOUBLE) AS value
          FROM v_hex x JOIN range(3) c(c) ON true JOIN range(16) b(b) ON true
          LEFT JOIN v_pixels p ON p.id = x.id AND p.c = c.c AND p.v // 16 = b.b GROUP BY 1, 2),
        s AS (SELECT id, CAST(48 + c AS INT) AS place, CAST(sum(v) AS DOUBLE) AS value FROM v_pixels GROUP BY id, c
              UNION ALL SELECT id, CAST(51 + c AS INT), round(CAST(CAST(stddev_pop(v / 255) AS FLOAT) AS DOUBLE), 4) FROM v_pixels GROUP BY id, c)
        SELECT id, place, value FROM (FROM h UNION ALL FROM s)""",
)
def a26(spark, folder):
    out = features.image_features(v.pixels(spark, folder), size=None)
    # densities back to pixel counts, means back to byte sums: whole numbers compare exactly
    value = F.col("value").cast("double")
    exact = F.when(F.col("place") < 48, F.round(value * 256)).when(F.col("place") < 51, F.round(value * 255 * 16))
    return out.select("id", F.posexplode("features").alias("place", "value")).select(
        "id", "place", exact.otherwise(F.round(value, 4)).alias("value")
    )


@query(
    "s7_resize_nearest",
    f"""WITH {v.V_PIXELS} SELECT id, CAST(sum(v) AS BIGINT) AS total FROM v_pixels
        WHERE p % 4 IN (1, 3) AND p // 4 IN (1, 3) GROUP BY id""",
)
def s7(spark, folder):
    small = features.resize_nearest("data", "height", "width", F.lit(2), F.lit(2))
    halved = v.pixels(spark, folder).select("id", F.hex(small).alias("h"))
    return halved.select("id", byte_total("h", 12).alias("total"))


def byte_total(hexed: str, n: int):
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.conv(F.substring(F.col(hexed), 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, b: acc + b)


@query(
    "p33_binarize_masks",
    f"""WITH {v.V_PIXELS}, g AS (SELECT id, p, (sum(v * CASE c WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) // 65536 AS luma
          FROM v_pixels GROUP BY id, p)
        SELECT id, CAST(sum(luma) AS BIGINT) AS luma_total, count(*) FILTER (luma > 0) AS set_pixels FROM g GROUP BY id""",
)
def p33_masks(spark, folder):
    gray = v.pixels(spark, folder).select("id", features.to_gray("data").alias("gray"))
    both = gray.select("id", F.hex("gray").alias("h"), F.hex(features.binarize_mask("gray")).alias("b"))
    return both.select("id", byte_total("h", 16).alias("luma_total"), byte_total("b", 16).alias("set_pixels"))


@query(
    "m2_flatten_images",
    f"WITH {v.V_PIXELS} SELECT id, CAST(i AS INT) AS place, CAST(v AS BIGINT) AS byte FROM v_pixels",
)
def m2(spark, folder):
    out = features.flatten_images(v.pixels(spark, folder), 4)
    return out.select("id", F.posexplode("features").alias("place", "value")).select(
        "id", "place", F.round(F.col("value") * 255).cast("bigint").alias("byte")
    )


@query(
    "p30_image_tensor",
    f"""WITH {v.V_PIXELS} SELECT id, CAST(c * 16 + p AS INT) AS place, CAST(v AS BIGINT) AS byte FROM v_pixels""",
)
def p30_tensor(spark, folder):
    mean, std = features.CHANNEL_MEAN, features.CHANNEL_STD
    out = features.image_tensor(v.pixels(spark, folder), 4)
    plane = F.floor(F.col("place") / 16).cast("int")
    back = F.col("value") * F.get(F.array(*[F.lit(s) for s in std]), plane) + F.get(F.array(*[F.lit(m) for m in mean]), plane)
    return out.select("id", F.posexplode("tensor").alias("place", "value")).select(
        "id", "place", F.round(back * 255).cast("bigint").alias("byte")
    )
