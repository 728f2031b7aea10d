"""Token counts of whole texts by the whole-token shortcut.

A byte-level tokenizer first cuts a text into pre-tokens and then merges the bytes
of each by itself. Most pre-tokens of ordinary prose are entries of the vocabulary, but
not every entry is reached by merging: so :func:`whole_tokens` proves, once and before any text is
read, which entries encode alone as exactly one token. Tasks count these
pre-tokens by looking them up, and only the rest is merged: by ranks where :func:`merge_ranks` proves that
this gives what the listed merges give, else by the tokenizer.

Every row is counted where it is read; nothing is shuffled. What is broadcast is bounded by the vocabulary.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import utf8, with_field

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512  # tokens of a document that is not over the limit
SEGMENT = 1 << 18  # characters that are cut into pre-tokens at once
CACHED = 600_000  # chunks and pre-tokens a task remembers
CACHED_CHARS = 48  # longer ones are not remembered
# a pre-token of letters ends before anything else, so a text may be taken apart there
_CUT = regex.compile(r"(?<=\p{L})\P{L}")


def load(path: str):
    """The tokenizer of a file, which has to be byte-level without a normaliser, and its added strings."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    made = json.loads(tokenizer.to_str())
    cutter = made["pre_tokenizer"] or {}
    if made["normalizer"] or cutter.get("type") != "ByteLevel" or not cutter["use_regex"] or cutter["add_prefix_space"]:
        raise ValueError(f"{path}: only byte-level tokenizers that cut texts as they are can be counted this way")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in made["added_tokens"]):
        raise ValueError(f"{path}: added tokens that look at what stands beside them are not supported")
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [x["content"] for x in made["added_tokens"]]


def assigned(text: str) -> bool:
    """Whether all characters have a category that libraries of any recent age agree on."""
    return text.isascii() or all(unicodedata.category(c) != "Cn" for c in text)


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The rank of every token if merging by the rank of joined bytes is the same as by the listed pairs, else None.

    Let every merge rank above its two parts. Then merges happen in order of rank, and what bytes
    between two ends have come to before rank r depends on these bytes alone as long as no merge has crossed an
    end. So it is enough that the bytes of each token come to exactly its listed pair by the merges before it:
    then no other pair can ever stand for the same bytes.
    """
    model = json.loads(load(path)[0].to_str())["model"]
    if any(model[k] for k in ("dropout", "unk_token", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    letters = {c: bytes([b]) for b, c in byte_letters().items()}
    ranks = {b"".join(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    merges = [tuple(b"".join(letters[c] for c in part) for part in m) for m in merges]
    if len(ranks) != 256 + len(merges) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    last = max(ranks[bytes([b])] for b in range(256))
    for left, right in merges:
        rank = ranks.get(left + right, -1)
        if rank <= last or reduced(left + right, ranks, rank) != [left, right]:
            return None
        last = rank
    return ranks


def reduced(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """What bytes come to by all merges of a rank under ``below``."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings proved to be one pre-token and to encode alone as one token."""
    tokenizer, _ = load(path)
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    proved = []
    for i, string, found in zip(ids, strings, encoded, strict=True):
        if found.ids == [i] and assigned(string) and len(tokenizer.pre_tokenizer.pre_tokenize_str(string)) == 1:
            proved.append(string)
    return frozenset(proved)


class Unassigned(Exception):
    """A character of which only the tokenizer itself can say whether it is a letter."""


class TokenCounter:
    """Numbers of tokens of texts, with a bounded memory of what has been merged.

    A blank after anything but white space begins a pre-token. So a text is looked up in chunks between blanks, and
    only a chunk that is not known is cut into its pre-tokens.
    """

    def __init__(self, path: str, whole: frozenset[str], ranks: dict[bytes, int] | None = None) -> None:
        self.tokenizer, added = load(path)
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pre_tokens = regex.compile(public_tokenizers.PATTERN).findall
        self.whole = whole
        self.merger = None
        if ranks:
            import tiktoken

            self.merger = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known = dict.fromkeys(self.whole, 1)
        #: chunks without the blank before them
        self.chunks = {w[1:]: 1 for w in self.whole if w[0] == " " and len(w) > 1 and not w[-1].isspace()}

    def __call__(self, text: str) -> int:
        """Added strings are one token each, wherever they stand; what lies between is counted by itself."""
        if self.added is None:
            return self.between(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.between, parts))

    def between(self, text: str) -> int:
        total = start = 0
        try:
            while start < len(text):
                end = len(text)
                if end - start > SEGMENT:
                    cut = _CUT.search(text, start + SEGMENT)
                    end = cut.start() if cut else end
                total += self.segment(text[start:end])
                start = end
        except Unassigned:
            return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return total

    def segment(self, text: str) -> int:
        if len(self.known) + len(self.chunks) > CACHED:
            self.forget()
        first, *chunks = text.split(" ")
        counts = list(map(self.chunks.get, chunks))
        if None in counts:
            rest = list({c for c, n in zip(chunks, counts, strict=True) if n is None})
            if any(not c or c[-1].isspace() for c in rest):  # a blank that may belong to the white space before it
                return self.merged([text])[0]
            new = dict(zip(rest, self.merged([" " + c for c in rest]), strict=True))
            self.chunks.update((c, n) for c, n in new.items() if len(c) <= CACHED_CHARS)
            counts = [new[c] if n is None else n for c, n in zip(chunks, counts, strict=True)]
        if chunks and first[-1:].isspace():
            return self.merged([text])[0]
        return sum(counts) + self.merged([first])[0]

    def merged(self, texts: list[str]) -> list[int]:
        """Tokens of texts that are cut into pre-tokens: whole ones are counted, the rest is merged."""
        cut = list(map(self.pre_tokens, texts))
        rest = list({w for words in cut for w in words if w not in self.known})
        if not all(map(assigned, rest)):
            raise Unassigned
        if self.merger is not None:
            encoded = map(self.merger.encode_ordinary, rest)
        else:
            encoded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        new = dict(zip(rest, map(len, encoded), strict=True))
        sizes = [sum([new[w] if w in new else self.known[w] for w in words]) for words in cut]
        self.known.update((w, n) for w, n in new.items() if len(w) <= CACHED_CHARS)
        return sizes


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """Tokens of every whole text; one row per row, as often as rows repeat.

    Strings of added tokens inside a text are one token each, as the library has it
    by default; nothing is added, cut or padded. A null text counts as an empty one: no bytes, no tokens. Null ids are
    kept, other columns are ignored, an empty table gives no rows. Long texts are counted
    in segments that end where a pre-token of letters ends, so only one without any such place is held as a whole.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast((whole_tokens(path), merge_ranks(path)))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(path, *proved.value)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column("text"):
                data = text.as_py()
                sizes.append(len(data))
                tokens.append(count(data.decode("utf-8", "replace")))
            tokens = np.array(tokens, np.int64)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = with_field(docs, id_col, "n_bytes bigint, n_tokens bigint, over_limit boolean")
    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, schema)
