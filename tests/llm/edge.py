"""Rows that every operator has to stand."""

import random

LONG = " ".join(f"Wort{i % 977} der {i % 31}" for i in range(30_000))
WORDS = "the of and to in is was with for that from this which there where these over under".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "er", str(rng.randrange(90))]) for _ in range(n))


def rows():
    """doc_id, text, lang, source, n_chars and columns whose names operators may use themselves."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    texts = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, ""), (5, None), (6, "   \n\t "), (7, "one"), (8, "two words"),
        (9, LONG), (10, "x" * 50_000), (11, "12345 ... !!! --"), (None, prose(2, 80)), (12, "a b c"), (13, "A B C"), (14, prose(3, 40)),
        (15, "ümläut ß nbsp em　wide 日本語のテキスト Привет мир"), (16, " ".join(near) + " tail"), (17, "a\x1cb\x85c\x0bd"),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang = [None, "en", "de"][i % 3]
        source = ["a", "a", "b", None][i % 4]
        out.append((doc_id, text, lang, source, None if text is None else len(text), i, "clash", 1.5, "k"))
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, node string, bin double, _key string"


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
