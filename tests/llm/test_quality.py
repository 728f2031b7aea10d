from tallyframe.llm import quality
from tests.llm import edge

FOLDER = "/root/testdata/sf0.1"


def test_accuracy_on_labels_not_seen(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = labels.where("pmod(xxhash64(doc_id), 3) <> 0")
    rest = labels.join(seen, "doc_id", "left_anti").withColumnRenamed("quality", "truth")
    rows = quality.classify(docs, seen).join(rest, "doc_id").collect()
    assert len(rows) > 1000
    right = sum(r.keep == (r.truth == 1) for r in rows)
    baseline = sum(r.truth == 1 for r in rows)
    assert right > baseline and right >= 0.93 * len(rows)
    assert sum(r.keep for r in rows if r.truth == 1) >= 0.97 * baseline


def test_edge_rows(spark):
    df = edge.table(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 3, 9, 12, 14, 15, 16, 17)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(df, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge.rows())
    assert all(0 <= r.quality <= 1 for r in rows)
    unlearned = quality.classify(df, labels.where("false")).collect()
    assert len(unlearned) == len(rows) and all(r.keep and r["quality"] is None for r in unlearned)
    assert quality.classify(edge.empty(spark), labels).count() == 0
