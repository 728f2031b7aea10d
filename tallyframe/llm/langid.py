"""Language of every word and span of a text.

The script of a word (by ranges of code points) narrows the languages that come into
question. Its character n-grams score those, as a naive Bayes classifier
learned from labelled documents. Viterbi over the words of a text, with a penalty
for every change of language, turns the scores into spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import claim_worker, with_field


BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS  # of the n-grams' hashes: the model has so many rows whatever it learns from
LONGEST_GRAM = 4
DOCS_PER_LANGUAGE = 1_000  # about as many labelled documents of a language are learned from
SWITCH = 6.0  # log-likelihood that a change of language has to gain
WORD_WEIGHT = 2.0  # weight of a word's mean n-gram
OTHER_SCRIPT = 15.0  # taken off for a language that is not written in a word's script
SCRIPT_SHARE = 0.01  # of a language's letters, to be one of its scripts
CACHED_WORDS = 250_000
CACHED_CHARS = 48
BATCH_WORDS = 300_000  # words labelled together
UNKNOWN = "und"
_ENDING_SIGNS = re.compile(r"(?<=[^\W\d_])[.,;:!?#$%&*]+(?=\s|$)")

# first code point of each range and its script; a range ends where the next begins
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"),
    (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"),
]
_FIRST = [first for first, _ in SCRIPTS]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_NUMBER = {name: i for i, name in enumerate(SCRIPT_NAMES)}
_OF_RANGE = [_NUMBER[name] for _, name in SCRIPTS]


def script_of(char: str) -> int:
    return _OF_RANGE[bisect_right(_FIRST, ord(char)) - 1]


def letters_of(word: str) -> str:
    """The letters of a word, in lower case."""
    if not word.isalpha():
        # marks belong to the letters they follow
        word = "".join(c for c in word if c.isalpha() or unicodedata.category(c)[0] == "M")
        if not any(map(str.isalpha, word)):
            return ""
    return word.lower()


def words_of(text: str) -> list[str]:
    """What white space parts, in lower case and without the signs that end a word."""
    return _ENDING_SIGNS.sub("", text.lower()).split()


def gram_buckets(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every n-gram of the words and of the words, their ends marked; all at once on code points."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, buckets = [], []
    hashes = np.zeros(len(codes), np.uint64)
    for n in range(1, min(LONGEST_GRAM, len(codes)) + 1):
        hashes = hashes[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        inside = owner[: len(hashes)] == owner[n - 1 :]
        spread = (hashes[inside] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[: len(hashes)][inside])
        buckets.append((spread ^ (spread >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BUCKET_BITS))
    starts = np.cumsum(sizes) - sizes
    places = np.arange(len(codes)) - np.repeat(starts, sizes)
    terms = (codes + np.uint64(1)) * (places.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    terms = (terms ^ (terms >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.add.reduceat(terms, starts)
    owners.append(np.arange(len(words)))
    buckets.append((whole ^ (whole >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BUCKET_BITS))
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, log-likelihoods
    scripts: np.ndarray  # scripts x languages, what is taken off


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Learns from about ``per_language`` documents of every language, chosen by hash of ``key``.

    Rows with a null text, language or key teach nothing. What comes to the driver is
    one row per language, then ``BUCKETS`` rows per language at most.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), np.float32))
    odds = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, per_language / counts[name]) * (1 << 30)))])
    chosen = labelled.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < odds[F.col(lang)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.update((name, w) for w in words_of(value))
        found: Counter = Counter()
        spelled: dict[str, list[tuple[str, int]]] = {}
        for (name, word), n in words.items():
            letters = letters_of(word)
            if letters:
                found[name, -1 - script_of(letters[0])] += n * len(letters)
                spelled.setdefault(name, []).append((letters, n))
        for name, own in spelled.items():
            owner, bucket = gram_buckets([w for w, _ in own])
            sums = np.bincount(bucket, np.array([n for _, n in own])[owner], BUCKETS)
            found.update({(name, b): int(sums[b]) for b in np.flatnonzero(sums).tolist()})
        if found:
            keys, n = zip(*found.items(), strict=True)
            names, buckets = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(buckets, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"]
            )

    parts = chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, bucket int, n bigint")
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    column = {name: i for i, name in enumerate(languages)}
    table = np.zeros((BUCKETS, len(languages)))
    letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
    at = np.array([column[x] for x in rows.column("lang").to_pylist()], np.int64)
    bucket, n = np.asarray(rows.column("bucket"), np.int64), np.asarray(rows.column("n"))
    table[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    letters[-1 - bucket[bucket < 0], at[bucket < 0]] = n[bucket < 0]
    scores = np.log((table + 0.5) / (table.sum(0) + 0.5 * BUCKETS))
    written = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    off = np.where(written | ~written.any(1, keepdims=True), 0.0, -OTHER_SCRIPT)
    return LanguageModel(languages, scores.astype(np.float32), off.astype(np.float32))


class WordScores:
    """Scores of the words met so far; row 0 is for words without letters."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1, np.int64)

    def number(self, texts: list[list[str]]) -> np.ndarray:
        """Row of every word of the texts."""
        found = list(map(self.rows.get, chain.from_iterable(texts)))
        if None in found:
            self.add(list({w for w in chain.from_iterable(texts) if w not in self.rows}))
            found = list(map(self.rows.__getitem__, chain.from_iterable(texts)))
        return np.array(found, np.int32)

    def add(self, words: list[str]) -> None:
        spelled = [(w, x) for w in words if (x := letters_of(w))]
        self.rows.update(dict.fromkeys(words, 0))
        if not spelled:
            return
        self.rows.update({w: len(self.letters) + i for i, (w, _) in enumerate(spelled)})
        letters = [x for _, x in spelled]
        owner, bucket = gram_buckets(letters)
        size = np.bincount(owner, minlength=len(letters))
        new = np.empty((len(letters), self.scores.shape[1]), np.float32)
        for number in range(new.shape[1]):
            new[:, number] = WORD_WEIGHT * np.bincount(owner, self.model.scores[bucket, number], len(letters)) / size
        new += self.model.scripts[np.array([script_of(x[0]) for x in letters])]
        self.scores = np.concatenate([self.scores, new])
        self.letters = np.concatenate([self.letters, np.array([sum(map(str.isalpha, x)) for x in letters])])

    def trim(self) -> None:
        if len(self.rows) > CACHED_WORDS:
            self.clear()
        else:
            for word in [w for w in self.rows if len(w) > CACHED_CHARS]:
                del self.rows[word]


def best_path(scores: np.ndarray, rows: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi over many texts at once: the language of every word.

    ``rows`` are the words' rows of ``scores``, text after text. Texts go in order of length, so
    the ones that still have a word at a step are a prefix.
    """
    n = scores.shape[1]
    path = np.zeros(len(rows), np.int16)
    if n < 2 or not len(rows):
        return path
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts with a word at step t
    value = np.zeros((len(order), n), np.float32)
    back = []  # per step: whether a language was entered from the best one, and that
    for step, k in enumerate(active):
        value = value[:k]
        top = value.argmax(1)
        entry = value[np.arange(k), top] - switch
        entered = value < entry[:, None]
        back.append((entered, top.astype(np.int16)))
        value = np.where(entered, entry[:, None], value) + scores[rows[first[:k] + step]]
        value -= value.max(1, keepdims=True)
        if step + 1 < len(active) and active[step + 1] < k:
            last = value[active[step + 1] :].argmax(1)
            path[first[active[step + 1] : k] + step] = last
    path[first[: active[-1]] + len(active) - 1] = value.argmax(1)
    for step in range(len(active) - 1, 0, -1):
        k = active[step]
        entered, top = back[step]
        now = path[first[:k] + step]
        path[first[:k] + step - 1] = np.where(entered[np.arange(k), now], top, now)
    return path


def label_spans(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str | None = "text", switch: float = SWITCH
) -> DataFrame:
    """Spans of one language and the main language of every whole text.

    Returns ``doc_id, lang_pred, score, spans``, one row per row of ``docs``. Words are what white
    space parts; a span is ``first`` and ``past`` word, ``lang`` and its number of
    letters. ``lang_pred`` is the language with most letters, ``score`` its share of them; ties go to
    the first name. A null text, one without letters and any text under a
    model that has learned nothing is ``und`` with score 0 and no spans. Without a ``text_col``, ``id_col`` is a whole
    row and the text its field ``text``, sent once; spans are not returned then.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows
    spans = "array<struct<first:int,past:int,lang:string,letters:bigint>>"
    schema = with_field(docs, id_col, "lang_pred string, score double" + (f", spans {spans}" if text_col else ""))
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string()), ("letters", pa.int64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("langid")
        known = WordScores(broadcast.value)
        names = broadcast.value.languages
        for batch in batches:
            held, n_words = [], 0
            start = 0
            for i, text in enumerate(batch.column("text") if text_col else batch.column("doc_id").field("text")):
                words = words_of(text.as_py() or "") if names else []
                held.append(words)
                n_words += len(words)
                if n_words >= BATCH_WORDS or i + 1 == batch.num_rows:
                    yield labelled(batch.column("doc_id").slice(start, len(held)), held, known, names)
                    start, held, n_words = i + 1, [], 0
                    known.trim()

    def labelled(ids: pa.Array, texts: list[list[str]], known: WordScores, names: Sequence[str]) -> pa.RecordBatch:
        rows = known.number(texts)
        lengths = np.array([len(t) for t in texts])
        path = best_path(known.scores, rows, lengths, switch)
        letters = known.letters[rows] if len(rows) else rows
        owner = np.repeat(np.arange(len(texts)), lengths)
        total = np.zeros((len(texts), max(len(names), 1)), np.int64)
        np.add.at(total, (owner, path), letters)
        every, most = total.sum(1), total.argmax(1)
        found = every > 0
        changes = np.ones(len(rows), bool)
        changes[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
        score = np.where(found, total[np.arange(len(texts)), most] / np.maximum(every, 1), 0.0)
        pred = [names[m] if ok else UNKNOWN for m, ok in zip(most, found, strict=True)]
        if not text_col:
            return pa.RecordBatch.from_arrays([ids, pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])
        begin = np.flatnonzero(changes)
        past = np.append(begin[1:], len(rows))
        sums = np.add.reduceat(letters, begin) if len(begin) else begin
        doc = owner[begin]
        base = np.cumsum(lengths) - lengths
        keep = found[doc] if len(begin) else begin.astype(bool)
        begin, past, sums, doc = begin[keep], past[keep], sums[keep], doc[keep]
        spans = pa.StructArray.from_arrays(
            [
                pa.array((begin - base[doc]).astype(np.int32)),
                pa.array((past - base[doc]).astype(np.int32)),
                pa.array([names[x] for x in path[begin]], pa.string()),
                pa.array(sums.astype(np.int64)),
            ],
            fields=list(span_type.value_type),
        )
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(pred), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)], ["doc_id", "lang_pred", "score", "spans"]
        )

    sent = [F.col(id_col).alias("doc_id")] + ([F.col(text_col).alias("text")] if text_col else [])
    return docs.select(*sent).mapInArrow(label, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text divides by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and labels all: ``doc_id, held_out, lang_pred, score, spans``."""
    model = learn(docs.where(~held_out()))
    labels = label_spans(docs, model)
    return labels.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def keep_known_languages(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents whose language was found, with a score over ``least``; all their columns.

    The whole row goes through the labelling, so no join by id is needed and rows that repeat keep their
    own labels.
    """
    model = learn(docs.where(~held_out()))
    columns = docs.columns
    labels = label_spans(docs.select(F.struct(*columns).alias("_row")), model, "_row", None)
    kept = labels.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > least))
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in columns])


