"""run() against every stage done by hand, and the stages on rows that are hard."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from tallyframe.llm import langid, mixing, pii, simhash
from tests.llm import edge
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check, tokenizer  # noqa: F401
from tests.llm.test_simhash import jaccard, roots

FOLDER = "/root/testdata/sf0.001"


def test_run_is_its_stages_by_hand(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect() if labels[r.doc_id] != "und"}
    root = roots(sorted(rows), lambda a, b: jaccard(rows[a].text, rows[b].text) >= 0.8)
    kept = {i: (rows[i].source, pii.redacted(rows[i].text)) for i in set(root.values())}
    size = {i: len(t.encode().split()) for i, (_, t) in kept.items()}
    sources = defaultdict(list)
    for i in kept:
        sources[kept[i][0]].append(i)
    target = targets({s: sum(size[i] for i in ids) for s, ids in sources.items()})
    want = []
    for source, ids in sources.items():
        left = round(target[source])
        ids.sort(key=lambda i: __import__("hashlib").md5(f"42:{i}".encode()).hexdigest())
        while left > 0:
            for i in ids:
                if left > 0:
                    want.append((i, kept[i][1]))
                    left -= size[i]
    check(corpus_pipeline.run(spark, FOLDER).collect(), want, tokenizer, 2048)


@pytest.mark.parametrize("make", [edge.table, edge.empty])
def test_stages_on_hard_rows(spark, make):
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.schema == docs.schema
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "personal_data", "mix_sources", "pack_sequences"]
    assert mixing.SEED == 42 and simhash.COPY_WORDS == 5 and simhash.SIMILARITY == 0.8
