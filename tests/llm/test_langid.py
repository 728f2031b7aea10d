import itertools
import zlib

import numpy as np

from tallyframe.llm import langid
from tests.llm import edge

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert found.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [i for i, r in found.items() if r.held_out]
    right = sum(found[i].lang_pred == truth[i] for i in held)
    assert right >= 0.97 * len(held)


def test_edge_rows(spark):
    df = edge.table(spark)
    found = langid.predict_languages(df).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in edge.rows())
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {4, 5, 6, 11}
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.predict_languages(edge.empty(spark)).count() == 0
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).where("lang is null")
    assert {r.lang_pred for r in langid.predict_languages(unlabelled).collect()} == {"und"}


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.learn(docs)
    one = {r.lang: r.text for r in docs.collect() if r.text and len(r.text.split()) > 200}
    mixed = " ".join(one["en"].split()[:60] + one["de"].split()[:60])
    row = langid.label_spans(spark.createDataFrame([(1, mixed)], "doc_id int, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "de"]
    assert abs(row.spans[0].past - 60) <= 3


def test_kept_documents_are_whole_rows(spark):
    df = edge.table(spark)
    kept = langid.keep_known_languages(df)
    assert kept.schema == df.schema
    want = sorted((repr(r) for r in df.collect() if r.doc_id not in (4, 5, 6, 11)))
    assert sorted(map(repr, kept.collect())) == want


def test_scripts_narrow():
    assert [langid.SCRIPT_NAMES[langid.script_of(c)] for c in "aßЖ日かع한ω"] == ["latin", "latin", "cyrillic", "han", "kana", "arabic", "hangul", "greek"]


def test_best_path_is_the_best():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(40, 3)).astype(np.float32)
    lengths = np.array([1, 6, 0, 4, 6, 2])
    rows = rng.integers(0, 40, lengths.sum())
    path = langid.best_path(scores, rows, lengths, 1.0)
    at = 0
    for n in lengths:
        mine, words = path[at : at + n], rows[at : at + n]
        at += n

        def value(labels, words=words):
            return sum(scores[w, x] for w, x in zip(words, labels, strict=True)) - sum(a != b for a, b in itertools.pairwise(labels))

        if n:
            assert abs(value(mine) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-4


def test_grams_up_to_four_and_the_word():
    words = ["a", "abcdefgh", "abcdefgx", "abcdefgh"]
    owner, bucket = langid.gram_buckets(words)
    sizes = [len(w) + 2 for w in words]
    assert np.bincount(owner).tolist() == [sum(max(0, n - k + 1) for k in (1, 2, 3, 4)) + 1 for n in sizes]
    whole = bucket[-len(words) :]
    assert whole[1] == whole[3] and len(set(whole.tolist())) == 3
    alone = langid.gram_buckets(["abcdefgh"])[1]
    assert sorted(alone) == sorted(bucket[owner == 1])
