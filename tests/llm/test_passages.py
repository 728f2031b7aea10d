import random

import numpy as np

from tallyframe.llm import passages
from tallyframe.llm.simhash import run_hashes
from tests.llm import edge


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(2)
    for n in (1, 5, 9, 60, 200):
        for high in (4, 1 << 60):
            values = rng.integers(0, high, n).astype(np.uint64)
            want = set()
            for c in range(n):
                left = right = c
                while left > 0 and values[left - 1] > values[c]:
                    left -= 1
                while right + 1 < n and values[right + 1] >= values[c]:
                    right += 1
                if right - left + 1 >= 7:
                    want.add((left, c, right))
            assert set(map(tuple, passages.compact_windows(values, 7).tolist())) == want


def test_planted_passages(spark):
    rng = random.Random(6)
    common = edge.prose(900, 70).split()
    line = edge.prose(901, 30).split()
    docs, planted = [], {}
    for i in range(120):
        words = [f"{w}{i}" for w in edge.prose(i, rng.randrange(60, 400)).split()]
        at = rng.randrange(len(words))
        if i % 4 == 0:
            mine = list(common)
            if i % 8 == 0:
                mine[rng.randrange(70)] = f"changed{i}"
            words[at:at] = mine
            planted[i] = at
        elif i % 4 == 1:
            words[at:at] = line  # too short
        docs.append((i, " ".join(words)))
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == set(planted)
    texts = {i: t.split() for i, t in docs}
    covered = {i: set() for i in planted}
    for r in found:
        covered[r.doc_id] |= set(range(r.first_word, r.past_word))
        a = texts[r.doc_id][r.first_word : r.past_word]
        b = texts[r.other_id][r.other_first_word : r.other_first_word + len(a)]
        assert len(a) >= 50 and sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    for i, at in planted.items():
        assert len(covered[i] & set(range(at, at + 70))) >= 50


def test_edge_rows(spark):
    df = edge.table(spark)
    found = passages.repeated_passages(df).collect()
    assert {(r.doc_id, r.other_id) for r in found} >= {(2, 1), (1, 2)}
    assert {r.doc_id for r in found} == {1, 2, 3, 16}
    assert passages.repeated_passages(edge.empty(spark)).count() == 0


def test_tasks_with_many_windows(spark, monkeypatch):
    docs = [(i, edge.prose(77, 200) + f" {edge.prose(i, 80)}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    want = {r.doc_id for r in passages.repeated_passages(df).collect()}
    assert want == set(range(30))


def test_words_put_in_or_left_out(spark):
    docs, pairs = [], []
    for n, size in enumerate((60, 75, 95)):
        for kind in ("in", "out"):
            common = [f"{w}c{n}{kind}" for w in edge.prose(300 + n, size).split()]
            half = size // 2
            other = [*common[:half], "new", *common[half:]] if kind == "in" else [*common[:half], *common[half + 1 :]]
            for words in (common, other):
                i = len(docs)
                docs.append((i, " ".join([f"{w}{i}" for w in edge.prose(i, 80).split()] + words + [f"{w}x{i}" for w in edge.prose(i, 40).split()])))
            pairs.append((len(docs) - 2, len(docs) - 1, len(common), len(other)))
    found = {(r.doc_id, r.other_id): r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for a, b, n, m in pairs:
        assert (found[a, b].first_word, found[a, b].past_word, found[a, b].other_first_word) == (80, 80 + n, 80)
        assert (found[b, a].first_word, found[b, a].past_word) == (80, 80 + m)
        shingles = max(n, m) - 4
        least = shingles - 5
        assert abs(found[a, b].similarity - least / (shingles + shingles - 1 - least)) < 1e-9
    assert len(found) == 2 * len(pairs)


def test_every_stretch_of_a_run():
    def hashes(*parts):
        return np.concatenate([np.arange(first, first + n) for first, n in parts]).astype(np.uint64)

    # two exact stretches, and a third with a gap of its own, over wide gaps: the whole is under the limit
    a = hashes((0, 60), (1000, 9), (200, 70), (1100, 10), (400, 40), (1200, 4), (440, 40))
    b = hashes((0, 60), (2000, 10), (200, 70), (2100, 9), (400, 40), (2200, 4), (440, 40))
    found = passages.shared(a, b, [0], 50, 0.9)
    assert {(f[0], f[1] - 4) for f in found} == {(0, 60), (69, 139), (149, 233)}
    assert [f[4] for f in sorted(found)] == [1.0, 1.0, 80 / 88]


def test_copies_behind_a_frequent_line(spark):
    docs, pairs = [], []

    def add(middle):
        i = len(docs)
        docs.append((i, " ".join([f"{w}{i}" for w in edge.prose(i, 60).split()] + middle + [f"{w}x{i}" for w in edge.prose(i, 60).split()])))
        return i

    for n in range(60):
        line = [f"{w}l{n}" for w in edge.prose(950 + n, 49).split()]
        tail = [f"{w}t{n}" for w in edge.prose(500 + n, 6).split()]
        middle = line + tail if n % 2 else tail + line
        add(line)
        pairs.append((add(middle), add(middle)))
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    got = {(r.doc_id, r.other_id): (r.first_word, r.past_word) for r in found}
    assert got == {p: (60, 115) for a, b in pairs for p in ((a, b), (b, a))}


def test_texts_hashed_together():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcXYZ0.,\x00\x1c\x85\xc3\xa9") for _ in range(n)) for n in [*range(1, 40)] * 8]
    rng.shuffle(words)
    blanks = b" \t\n\r\x0b\x0c"
    texts = [b"", b" ", b"one", b"a b c d", b" A b c d e\n"]
    for n in (3, 5, 50, 200):
        texts.append(b"".join(w + bytes(rng.choice(blanks) for _ in range(rng.randrange(1, 3))) for w in rng.sample(words, n)))
    for some in (texts, texts[:1], texts[-1:], []):
        for got, text in zip(passages.hashed(some), some, strict=True):
            assert np.array_equal(got, run_hashes(text, passages.SHINGLE))


def test_windows_of_texts_behind_each_other():
    rng = np.random.default_rng(3)
    for high in (1, 2, 4, 30, 1 << 60):
        for _ in range(30):
            texts = [rng.integers(1, high + 1, rng.integers(7, 60)).astype(np.uint64) for _ in range(rng.integers(1, 5))]
            starts = np.cumsum([0, *map(len, texts[:-1])])
            want = [passages.compact_windows(t, 7)[:, 1] + s for t, s in zip(texts, starts.tolist(), strict=True)]
            assert np.array_equal(passages.window_places(np.concatenate(texts), starts, 7), np.concatenate(want))


def test_stretches_by_themselves_are_not_extended(monkeypatch):
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 60, 47).astype(np.uint64)
    a = np.concatenate([x for _ in range(30) for x in (line, rng.integers(0, 1 << 60, 30).astype(np.uint64))])
    b = np.concatenate([x for _ in range(20) for x in (line, rng.integers(0, 1 << 60, 41).astype(np.uint64))])
    calls = []
    extended = passages.extended
    monkeypatch.setattr(passages, "extended", lambda *x: calls.append(1) or extended(*x))
    found = passages.shared(a, b, sorted({77 * i - 88 * j for i in range(30) for j in range(20)}), 50, 0.8)
    want = {(77 * i, 77 * i + 51, 88 * j, 88 * j + 51, 1.0) for i in range(30) for j in range(20)}
    assert len(found) == len(want) and set(found) == want
    assert not calls


def test_id_of_a_long_and_a_short_text(spark):
    line = [f"{w}l" for w in edge.prose(31, 49).split()]
    docs = [(1, " ".join(line))]
    for i in range(2, 8):
        tail = [f"{w}t{i // 2}" for w in edge.prose(40 + i // 2, 6).split()]
        docs.append((i, " ".join([f"{w}{i}" for w in edge.prose(i, 300).split()] + line + tail)))
        docs.append((i, edge.prose(60 + i, 7)))
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(2, 3), (3, 2), (4, 5), (5, 4), (6, 7), (7, 6)}
