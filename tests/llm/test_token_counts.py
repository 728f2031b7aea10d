import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import token_counts as tc
from tests.llm import edge

PATH = public_tokenizers.path(tc.TOKENIZER)
ODD = [
    "", " ", "  ", "a", " a", "a  b", "a   b\n", "\n b", "a\n\n  b \t c", "don't they'll 'sab x's", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endo",
    "՘a՘ b", "x₏1", "日本語のテキスト、です。", "\U0001f469‍\U0001f680 ok", "a\x1c b\x85c\x0b d　 e", "ﬁ ½ ² Ⅷ 1٣4", "  x   y",
    "    indented\n        more\n", "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 1000, "\r\n\r\n", "é é ", "a  b", "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def proved():
    return tc.whole_tokens(PATH)


def test_whole_tokens_are_proved(proved, library):
    vocabulary = Tokenizer.from_file(PATH).get_vocab()
    assert 49_000 < len(proved) < len(vocabulary)
    assert "<|endoftext|>" not in proved
    assert all(library(w) == 1 for w in random.Random(1).sample(sorted(proved), 3000))


def test_merge_ranks_are_proved_or_refused(tmp_path):
    ranks = tc.merge_ranks(PATH)
    assert len(ranks) == 50_256
    odd = Tokenizer.from_file(PATH).to_str().replace('"ignore_merges":false', '"ignore_merges":true')
    (tmp_path / "odd.json").write_text(odd)
    assert tc.merge_ranks(str(tmp_path / "odd.json")) is None
    assert tc.reduced(b"hello", {**ranks}, 300) != tc.reduced(b"hello", {**ranks}, 50_000)


@pytest.mark.parametrize("by_rank", [True, False])
def test_texts_against_the_library(proved, library, by_rank, monkeypatch):
    monkeypatch.setattr(tc, "SEGMENT", 40)
    monkeypatch.setattr(tc, "CACHED", len(proved) * 2 + 50)
    count = tc.TokenCounter(PATH, proved, tc.merge_ranks(PATH) if by_rank else None)
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choices(ODD, k=rng.randrange(8))) for _ in range(400)]
    texts += ["".join(rng.choices("aB é'ß\n\t1٢,.<|> ՘漢　", k=rng.randrange(200))) for _ in range(400)]
    texts += [edge.prose(i, 200) for i in range(20)]
    assert [count(t) for t in texts] == list(map(library, texts))


def test_odd_rows(spark, library):
    rows = [(i, t) for i, t, *_ in edge.rows()]
    got = tc.count_tokens(edge.table(spark), limit=2).collect()
    want = [(i, len((t or "").encode()), n := library(t or ""), n > 2) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tc.count_tokens(edge.empty(spark)).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tc.load(public_tokenizers.path("word_bpe_49k.json"))


def test_query_against_the_library(spark, library):
    from tallyframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_token_counts"](spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row.doc_id] or ""
        n = library(text)
        assert tuple(row) == (row.doc_id, len(text.encode()), n, n > 512)
