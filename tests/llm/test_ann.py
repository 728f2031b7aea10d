import math

import numpy as np

from tallyframe.llm import ann


def brute(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(np.float64))
    out = {}
    for q, v in good.items():
        if q % every == 0:
            scores = sorted((-float(v[: len(w)] @ w[: len(v)]), i) for i, w in good.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id bigint, embedding array<float>, score double")
    out = {}
    for r in sorted(ann.nearest(df, ann.F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        true = dict(want[q])
        assert all(abs(s - true[i]) < 1e-12 for _, i, s in rows if i in true)
        hits += sum(i in true for _, i, _ in rows)
    assert hits >= 0.95 * 20 * len(want)


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [0.0, 0.0]),
            (None, [1.0, 1.0]), (20, [-1.0, 0.5]), (6, [3.0]), (7, [100.0, -100.0]), (8, []), (40, [1.0, 2.0]), (41, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(0, [1.0])]) == {}
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == {}


def test_equal_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype(np.float32).tolist()
    rows = [(i, base[0] if i % 3 == 0 else base[i % 40]) for i in range(200)]
    assert run(spark, rows) == brute(rows)
