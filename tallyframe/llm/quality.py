"""Text quality by co-training of two views.

One classifier sees the words of a text, the other the page's metadata: language, source
and how the text is laid out. In every round each labels the unlabelled documents it is sure of, for
the other to learn from. At the end both views' margins are calibrated together on labelled documents that neither
has seen, and all documents are scored.

Fitting uses bounded samples (``LABELLED``, ``POOL``); scoring covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

LABELLED = 10_000  # about as many labelled documents are learned from
POOL = 10_000  # and about as many unlabelled ones get pseudo-labels
ROUNDS = 2
SURE = 0.95
KEEP = 0.5
TEXT_FEATURES = 1 << 12
META_FEATURES = 1 << 8
CALIBRATION = 5  # one in so many labelled documents is for calibration
STEPS = 25


def share(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern)) / (1 + F.length(column))


def views(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``doc_id`` and the features of both views; null texts count as empty, null values as a value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("body"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("-")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("-")).alias("source"),
    )
    # a word and the signs that follow it are terms of their own
    rows = rows.withColumn("terms", F.split(F.lower("body"), r"(?<=\w)(?=[^\w\s])|\s+"))
    rows = HashingTF(numFeatures=TEXT_FEATURES, inputCol="terms", outputCol="counts").transform(rows)
    size = F.size("terms")
    meta = {
        "length": F.log1p(F.length("body").cast("double")),
        "term_length": F.length("body") / size,
        "lines": 10 * share("body", r"\n"),
        "capitals": 10 * share("body", r"[A-Z]"),
        "digits": 10 * share("body", r"[0-9]"),
        "signs": 10 * share("body", r"[|#$%&*!<>{}=_]"),
        "stops": 10 * share("body", r"[.,]"),
    }
    rows = rows.withColumns(meta)
    hashed = FeatureHasher(numFeatures=META_FEATURES, inputCols=["lang", "source"], outputCol="named")
    rows = hashed.transform(rows)
    rows = VectorAssembler(inputCols=[*meta, "named"], outputCol="meta").transform(rows)
    return rows.select("doc_id", F.col("counts").alias("words"), "meta")


@dataclass
class QualityModel:
    words: LogisticRegressionModel
    meta: LogisticRegressionModel
    both: LogisticRegressionModel | None


def margins(model: QualityModel, rows: DataFrame) -> DataFrame:
    """Adds ``p_words, p_meta`` and the vector ``margins`` of both views."""
    for name in ("words", "meta"):
        fitted = getattr(model, name).setFeaturesCol(name).setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_y")
        rows = fitted.transform(rows)
        rows = rows.withColumn(f"p_{name}", vector_to_array("_p")[1]).withColumn(f"m_{name}", vector_to_array("_raw")[1]).drop("_raw", "_p", "_y")
    return VectorAssembler(inputCols=["m_words", "m_meta"], outputCol="margins").transform(rows)


def fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=view, labelCol="label", maxIter=STEPS, regParam=1e-3).fit(rows)


def chance(key: str, seed: int) -> Column:
    """A number from 0 to 1 that a row keeps over reruns."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def learn(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> QualityModel | None:
    """Co-trains on about ``labelled`` documents with a label of 0 or 1 and ``pool`` without; none if only one label occurs."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min(label_col).cast("double").alias("label"))
    n_known, n_docs = known.count(), docs.count()
    some = known.where(chance("_id", 1) < labelled / max(n_known, 1))
    own = docs.join(some, docs[id_col] == some["_id"]).drop("_id")
    features = views(own.select(id_col, text_col, lang_col, source_col), id_col, text_col, lang_col, source_col)
    marked = stored(features.join(some, features["doc_id"] == some["_id"]).drop("_id"), "labelled")
    test = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(CALIBRATION)) == 0
    train, calibrate = marked.where(~test), marked.where(test)
    if train.select("label").distinct().count() < 2:
        return None
    drawn = docs.where(chance(id_col, 3) < pool / max(n_docs, 1))
    rest = drawn.join(known, drawn[id_col] == known["_id"], "left_anti")
    rest = stored(views(rest, id_col, text_col, lang_col, source_col), "unlabelled")
    sets = {"words": train, "meta": train}
    model = QualityModel(fit(train, "words"), fit(train, "meta"), None)
    for _ in range(rounds):
        scored = stored(margins(model, rest).select("doc_id", "words", "meta", "p_words", "p_meta"), "pseudo")
        for view, other in (("words", "meta"), ("meta", "words")):
            sure = scored.where((F.col(f"p_{other}") >= SURE) | (F.col(f"p_{other}") <= 1 - SURE))
            taught = sure.select("doc_id", "words", "meta", (F.col(f"p_{other}") > 0.5).cast("double").alias("label"))
            sets[view] = train.unionByName(taught)
        model = QualityModel(fit(sets["words"], "words"), fit(sets["meta"], "meta"), None)
    if calibrate.select("label").distinct().count() == 2:
        model.both = fit(margins(model, calibrate), "margins")
    return model


def score(docs: DataFrame, model: QualityModel | None, keep: float = KEEP, **columns: str) -> DataFrame:
    """``doc_id, p_words, p_meta, quality, keep`` per row of ``docs``.

    ``quality`` is the chance of a good document by both views; without a model it is null and all
    are kept, without calibration it is the mean of the views.
    """
    names = {"id_col": "doc_id", "text_col": "text", "lang_col": "lang", "source_col": "source", **columns}
    rows = views(docs, **names)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("p_words"), none.alias("p_meta"), none.alias("quality"), F.lit(True).alias("keep"))
    scored = margins(model, rows)
    if model.both is None:
        quality = (F.col("p_words") + F.col("p_meta")) / 2
    else:
        fitted = model.both.setFeaturesCol("margins").setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_y")
        scored = fitted.transform(scored)
        quality = vector_to_array("_p")[1]
    return scored.select("doc_id", "p_words", "p_meta", quality.alias("quality"), (quality >= keep).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns quality from ``labels`` and scores all documents."""
    return score(docs, learn(docs, labels))
