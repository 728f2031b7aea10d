import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallyframe.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, n bigint, container string, depth int"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        seq = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
        ended[seq].append(conv)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    kids = Counter(seq[:-1] for seq in members if seq)
    leaves, saved = Counter(), Counter()
    for seq, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not kids[seq]
            saved[seq[:d]] += (len(m) - 1) * words
    out = []
    for seq, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ended[seq]))).encode() if seq in ended else b"").hexdigest()
        out.append((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), kids[seq], leaves[seq], saved[seq], digest))
    return sorted(out, key=repr)


def run(spark, rows, most=None):
    df = spark.createDataFrame([(*r, "p", 1, "c", 2) for r in rows], SCHEMA).repartition(3)
    got = pt.prefix_trie(df, most=most)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def forest(seed, n):
    """Conversations with few different turns, so that they share beginnings, end inside others and repeat."""
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            role, text = rng.choice(["user", "bot", None]), rng.choice(["hi  there", "", None, "a\x85b c", "x"][: 1 + conv % 5])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
    rng.shuffle(rows)
    return rows


def untied(rows):
    """Equal turn numbers are told apart by a hash, so the brute-force version sees none but equal rows."""
    seen, out = set(), []
    for conv, turn, role, text in rows:
        if (conv, turn) not in seen:
            seen.add((conv, turn))
            out.append((conv, turn, role, text))
    return out


@pytest.mark.parametrize("most", [None, 20, 3, 1])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pt, "PIECE", 7)
    monkeypatch.setattr(pt, "ROWS", 50)
    rows = untied(forest(1, 300))
    assert run(spark, rows, most) == brute(rows)


@pytest.mark.parametrize("most", [None, 1])
def test_hot_beginnings_and_copies(spark, monkeypatch, most):
    """Nine in ten conversations are copies; the others share all but their last turns, and some begin others."""
    monkeypatch.setattr(pt, "PIECE", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 360) for t in range(6)]
    rows += [(c, t, "user", f"turn {t}" if t < 2 + c % 9 else f"own {c % 4}") for c in range(400, 440) for t in range(3 + c % 9)]
    assert run(spark, rows, most) == brute(rows)


def test_odd_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    one = [(7, None, None, None)]
    assert run(spark, one) == brute(one)
    # h of 1 is 3: with nothing to follow, conversation 1 has no turns at all
    assert [zlib.crc32(str(c).encode()) % 4 for c in (1, 20, 21)].count(0) < 3
    rows = [(1, 0, "a", "b c"), (1, 1, "a", "b c"), (20, 0, "a", "b c"), (21, 5, None, "word " * 100_000), (21, 6, "a", ""), (-5, 1, "a", "x"),
            (40, 1, "r", "same"), (40, 1, "r", "same"), (41, 1, "r", "same"), (41, 1, "r", "same"), (None, None, None, None)]
    floor = [r for r in rows if r[0] is None or r[0] >= 0]
    assert run(spark, floor) == brute(floor)
    assert len(run(spark, rows)) >= len(brute(floor))


def test_role_and_text_are_told_apart(spark):
    rows = [(100, 0, "ab", "c"), (120, 0, "a", "bc"), (140, 0, "", "abc"), (160, 0, None, "abc")]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, rows)) == 4
