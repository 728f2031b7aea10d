from collections import defaultdict

import duckdb
import pytest

from tallyframe.llm import mixing
from tests.llm import edge


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over a cap reshared until there is none."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, free = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while free and left > 1e-9:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if target[n] + share[n] > most * sizes[n] + 1e-9]
        for n in free:
            target[n] = min(target[n] + share[n], most * sizes[n])
        left = total - sum(target.values())
        free -= set(over)
    return target


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 1, 50)])
def test_edge_rows(spark, weights):
    df = edge.table(spark)
    rows = mixing.mix(df, weights=weights).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge.rows())
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {str(r.doc_id): r.source for r in df.collect()}
    for r in df.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = targets(dict(sizes), weights)
    for r in rows:
        assert r.taken <= 3 * r.size
        if str(r.doc_id) != "2":  # the id that repeats over two sources
            assert r.target == pytest.approx(want[source[str(r.doc_id)]])
    by_target = defaultdict(int)
    for r in rows:
        by_target[r.target] += r.taken
    for target, n in by_target.items():
        same = sum(abs(t - target) < 1e-6 for t in want.values())
        assert abs(n - same * target) <= same
    assert mixing.mix(edge.empty(spark)).collect() == []


def test_matches_sql_on_another_table(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = sorted(duck.execute(mixing.SQL).fetchall())
    assert sorted(map(tuple, mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).collect())) == want


def test_documents_come_as_often_as_taken(spark):
    df = edge.table(spark).where("doc_id <> 2")
    mixed = mixing.mix_documents(df, weights=(1, 9, 1))
    assert mixed.schema == df.schema
    often = defaultdict(int)
    for r in mixed.collect():
        often[r.doc_id] += 1
    for r in mixing.mix(df, weights=(1, 9, 1)).collect():
        assert often[r.doc_id] == (-(-r.taken // r.size) if r.taken else 0)
    assert mixing.mix_documents(edge.empty(spark)).count() == 0
