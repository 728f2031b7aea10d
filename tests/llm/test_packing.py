import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import packing
from tests.llm import edge


def pieces(text, tokenizer, capacity):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    for number, start in enumerate(range(0, len(ids), capacity)):
        part = np.array(ids[start : start + capacity], "<u4")
        yield number, start, len(part), zlib.crc32(part.tobytes())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check(rows, docs, tokenizer, capacity):
    want = Counter((d, *p) for d, text in docs for p in pieces(text, tokenizer, capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(n for _, _, _, n, _ in want.elements())


def test_edge_rows(spark, tokenizer):
    df = edge.table(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    for capacity in (16, 2048):
        check(packing.pack(df, capacity=capacity).collect(), docs, tokenizer, capacity)
    assert packing.pack(edge.empty(spark)).collect() == []


def test_documents(spark, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    made, tokens = check(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()], tokenizer, 2048)
    assert made <= 1.03 * tokens / 2048 + 1


def test_words_encode_as_texts(tokenizer):
    encode = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))
    hard = "Σ ά́ <|endoftext|>x don't 'S a b　c ́d e​f﻿g \x1c\x1d\x85 ﬁ Å 12,5 I'LL we’ve J̌K J̌. ok., (a), x$.. #a. É. é! <|ENDOFTEXT|> A" + edge.LONG[:4000]
    for text in [hard, hard[::-1], "", " ", "a" * 3000, "Plain WORDS, only. 'S A$%. B", "ÉTÉ, Été. J'ai «Non». ÀB!"]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 5, 10]), 10)
    assert bins.tolist() == [1, 2, 1, 2, 0]
    assert offsets.tolist() == [0, 0, 6, 5, 0]
