import random
from collections import defaultdict

import numpy as np
import xxhash

from tallyframe.llm import simhash
from tests.llm import edge


def fingerprint(text, words=3):
    tokens = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def brute(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = roots(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for (i, _), p in zip(docs, prints, strict=True):
        least[root[p]] += [] if i is None else [i]
    return sorted((repr(i), p, min(least[root[p]], default=None)) for (i, _), p in zip(docs, prints, strict=True))


def found(df):
    return sorted((repr(r.doc_id), r["print"] % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())


def test_edge_rows(spark):
    docs = [(r[0], r[1]) for r in edge.rows() if r[0] != 9]
    df = edge.table(spark).where("doc_id is null or doc_id <> 9")
    assert found(df) == brute(docs)
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_tiles_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = set(seeds)
    for s in seeds[:6]:  # chains of near fingerprints: buckets larger than a tile
        for _ in range(40):
            s ^= (1 << rng.randrange(64)) | (1 << rng.randrange(21))
            prints.add(s)
    monkeypatch.setattr(simhash, "TILE", 7)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "node bigint").withColumn("w0", simhash.F.col("node"))
    links = simhash.tile_links(df.withColumn("keys", simhash.block_keys(df.w0)), ["w0"], 2)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = roots(signed, lambda a, b: (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def jaccard(x, y):
    p, q = (set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in (x, y))
    return 1.0 if (x or "") == (y or "") else len(p & q) / max(1, len(p | q))


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        words = edge.prose(100 + g, rng.randrange(30, 400)).split()
        for _ in range(rng.randrange(1, 6)):
            rows.append(" ".join(words))
            words = [w if rng.random() > 0.01 else "changed" + str(rng.random()) for w in words]
    rows += ["", None, "", "short", "Short"]
    docs = [(i, t) for i, t in enumerate(rows)]
    rng.shuffle(docs)
    texts = dict(docs)
    root = roots(sorted(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    df = spark.createDataFrame(docs + [docs[0]], "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(df).collect())
    assert kept == sorted(set(root.values()))


def test_near_copies_of_edge_rows(spark):
    df = edge.table(spark)
    kept = simhash.drop_near_copies(df)
    assert kept.schema == df.schema
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i in (1, 4, 6, 7, 8, 9, 10, 11, 12, None, 14, 15, 17))
    assert simhash.drop_near_copies(edge.empty(spark)).count() == 0
