import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyframe.llm import lexical
from tests.llm import edge

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
EXTRA = "item bigint, term string, score double, part int"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    """docs: (id, text) rows; items: distinct (id, text) rows."""
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k):
    left = spark.createDataFrame([(i, t, 1, "x", 2.0, 3) for i, t in docs], f"doc_id bigint, text string, {EXTRA}").repartition(3)
    right = spark.createDataFrame([(i, t, 1, "x", 2.0, 3) for i, t in items], f"item_id bigint, text string, {EXTRA}")
    return sorted(map(tuple, lexical.search(left, right, k).collect()), key=repr)


@pytest.mark.parametrize("few", [True, False])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(lexical, "BLOCK", 60)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    monkeypatch.setattr(lexical, "WINDOWS", (4, 16))
    monkeypatch.setattr(lexical, "SALTS", 3)
    if not few:
        monkeypatch.setattr(lexical, "LISTED_TERMS", (0, 0))
    rng = random.Random(3)
    docs = [(i, edge.prose(i, rng.randrange(1, 120))) for i in range(400)]
    docs += [(1000 + i, docs[i % 9][1]) for i in range(90)]  # ties between copies
    items = [(i, edge.prose(500 + i, 25) + " The THE") for i in range(20)]
    got = run(spark, docs, items, 10)
    assert len(got) == 200 and got == brute(docs, items, 10)


def test_odd_rows(spark):
    docs = [(i, t) for i, t, *_ in edge.rows()]
    items = [(1, "Wort1 der x ONE"), (2, None), (3, ""), (4, "... --"), (None, "a b"), (5, "absent"), (6, "日本語のテキスト мир"), (1, "ümläut"),
             (7, "one"), (7, "one"), (8, edge.LONG)]
    assert run(spark, docs, items, 20) == brute(docs, list(dict.fromkeys(items)), 20)
    assert run(spark, [], items, 20) == []
    assert run(spark, docs, [], 20) == []
    assert run(spark, [(1, None), (2, " .")], items, 20) == []


def test_a_term_of_all_documents_weighs_nothing(spark):
    docs = [(i, "common") for i in range(5000)]
    assert run(spark, docs, [(1, "common")], 3) == brute(docs, [(1, "common")], 3) == []


def test_blocks_skip_and_stay_exact():
    rng = np.random.default_rng(5)
    for size in (1, 50, 3000):
        for _ in range(60):
            lists, sums = [], defaultdict(int)
            for _ in range(rng.integers(0, 12)):
                places = np.flatnonzero(rng.random(size) < rng.choice([0.002, 0.05, 0.6])).astype(np.int32)
                scores = rng.integers(0, rng.choice([3, 10, 1000]), len(places)).astype(np.int64)
                lists.append((places, scores))
                for p, s in zip(places.tolist(), scores.tolist(), strict=True):
                    sums[p] += s
            want = sorted((-s, p) for p, s in sums.items() if s > 0)[:7]
            places, scores = lexical.search_block(lists, size, 7)
            assert [(-s, p) for p, s in zip(places.tolist(), scores.tolist(), strict=True)] == want
