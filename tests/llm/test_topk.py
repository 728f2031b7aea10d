import math

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import topk


def brute(rows, every, k, scale=256):
    good = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    return sorted(map(tuple, topk.exact_top_k(df, topk.F.col("vec_id") % 50 == 0, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "RESOLVED", 10)
    monkeypatch.setattr(topk, "CHUNK", 9)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # ties
    assert run(spark, rows) == brute(rows, 50, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [0.0, 0.0]),
            (None, [1.0, 1.0]), (50, [-1.0, 0.5]), (6, [3.0]), (7, [1e6, -1e6])]
    assert run(spark, rows) == brute(rows, 50, 5)
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0])]) == []


def test_no_row_holds_a_block(spark, monkeypatch):
    sent = []
    frame = type(spark.range(0))
    there = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: (sent.append(self), there(self, *a, **b))[1])
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    assert run(spark, rows) == brute(rows, 50, 5)
    widest = [df.select(topk.F.max(topk.F.length(topk.F.to_json(topk.F.struct("*"))))).first()[0] for df in sent]
    assert widest and max(widest) < 1000, widest


def test_rows_sent_follow_the_input():
    for n in (2_000, 51_282, 615_384, 15_000_000, 75_000_000):
        tiles, parts = topk.groups(n, n // 50)
        assert n * parts + n // 50 * tiles <= 8 * n
        assert n // 50 <= parts * topk.PART
    assert topk.groups(0, 0) == (1, 1)


def test_many_tiles_and_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_PAIRS", 1 << 9)
    monkeypatch.setattr(topk, "PART", 4)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "CHUNK", 5)
    monkeypatch.setattr(topk, "RESOLVED", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, size=rng.integers(0, 6)).astype(float).tolist()) for i in range(900)]  # ties, several lengths, none
    tiles, parts = topk.groups(900, 18)
    assert tiles > 1 and parts > 4
    assert run(spark, rows) == brute(rows, 50, 5)
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [100, 1 << 20, 1 << 28])
def test_blocks_of_a_group(size):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.integers(-size, size, (400, 12)), np.repeat(rng.integers(-size, size, (3, 12)), 60, axis=0)])
    ids = rng.permutation(len(vectors)) // 2  # repeated ids
    queries, own = np.concatenate([vectors[:20], vectors[-2:]]), np.concatenate([ids[:20], ids[-2:]])
    best = topk.Best(queries, own, 5, 20, 8, 6)
    for start in range(0, len(ids), 128):
        best.meet(vectors[start : start + 128], ids[start : start + 128])
    for i, query in enumerate(queries):
        scores = [sum(map(int.__mul__, query.tolist(), v)) for v in vectors.tolist()]
        expected = sorted((-s, x) for s, x in zip(scores, ids.tolist(), strict=True) if x != own[i])[:5]
        assert [(-s, x) for s, x in zip(best.scores[i].tolist(), best.ids[i].tolist(), strict=True)] == expected


def test_packed_vectors_come_back():
    few = [[1, -2], [0, 0], [-32768, 32767]]
    odd = [[], [1], [1 << 15, 2], [-(1 << 31)], [1 << 40, -5, 3], [-(1 << 63), (1 << 63) - 1]]
    for rows in (few, odd, [[], []], []):
        back = topk.unpacked(topk.packed(pa.array(rows, pa.list_(pa.int64()))))
        width = max(map(len, rows), default=0)
        assert back.tolist() == [r + [0] * (width - len(r)) for r in rows]
