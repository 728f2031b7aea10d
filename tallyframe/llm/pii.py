"""Personal data in texts, plain and disguised, at offsets of the source text.

Plain identifiers are found by fixed patterns. Disguised ones are found in a
normalised copy: transducers replace look-alike characters, spelled digits and
written-out "at" and "dot", and note which source characters each piece of the copy
comes from. What the patterns find in the copy is mapped back to the source.

Everything here is linear in the length of the text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import with_field

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of the kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Looks left from every @ that a domain follows: no run of characters is read twice."""
    past = 0
    if "@" not in text:
        return
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            past = m.end()
            yield start, past


def is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(found: str) -> bool:
    digits = "".join(_DIGIT.findall(found))
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 10 <= len(_DIGIT.findall(found)) <= 15


_CHECKED: list[tuple[int, re.Pattern, Callable[[str], bool]]] = [(1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)]


def identifiers(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of every kind that pass its check, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [(m.start(), kind, m.end()) for kind, pattern, ok in _CHECKED for m in pattern.finditer(text) if ok(m[0])]
        found.sort()
    return found


# Look-alikes of ASCII letters and signs; fixed values. Digits of all scripts and full-width forms follow from rules.
_LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-",
    "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}


def _look_alike_table() -> dict[int, str]:
    table = {ord(c): a for c, a in _LOOK_ALIKES.items()}
    table |= {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
    for c in range(0x80, sys.maxunicode + 1):
        value = unicodedata.decimal(chr(c), None)
        if value is not None:
            table[c] = str(value)
    return table


LOOK_ALIKES = _look_alike_table()
_SUSPECT = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(LOOK_ALIKES)) + "]")
_NUMBERS = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(_NUMBERS) + ")"
_SPOKEN = re.compile(rf"(?i)\b(?:plus[ -])?{_NUMBER}(?:[ -]{_NUMBER}){{9,}}\b")
_WORD = re.compile(r"[A-Za-z]+")
_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,2}"
_DOT = rf"(?:{_OPEN}dot{_CLOSE}|(?<=[A-Za-z0-9])[ ]dot[ ](?=[A-Za-z0-9]))"
_SPELLED = re.compile(
    rf"(?i)(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9])[ ]at[ ](?=[A-Za-z0-9-]{{1,63}}{_DOT}))"
    rf"|(?P<dot>{_DOT})|(?P<none>[\u200b-\u200d\u2060\ufeff\u00ad])"
)
_MAY_SPELL = re.compile(r"(?i)dot|[\[({<][ \t]{0,2}(?:at|@)|[\u200b-\u200d\u2060\ufeff\u00ad]")
_MAY_SPEAK = re.compile(rf"(?i){_NUMBER}[ -]{_NUMBER}[ -]{_NUMBER}")


def edits(text: str) -> list[tuple[int, int, str]]:
    """What the transducers replace in a text whose look-alikes are gone: start, end, replacement."""
    found = []
    if _MAY_SPELL.search(text):
        put = {"at": "@", "dot": ".", "none": ""}
        found += [(m.start(), m.end(), put[m.lastgroup]) for m in _SPELLED.finditer(text)]
    if _MAY_SPEAK.search(text):
        for m in _SPOKEN.finditer(text):
            words = _WORD.findall(m[0].lower())
            found.append((m.start(), m.end(), "".join("+" if w == "plus" else _NUMBERS[w] for w in words)))
        found.sort()
    return found


def disguised(text: str) -> list[Span]:
    """Identifiers that show only in the normalised text, at their source offsets."""
    plain = text.translate(LOOK_ALIKES) if not text.isascii() and _SUSPECT.search(text) else text
    changes = edits(plain)
    if plain is text and not changes:
        return []
    parts, made, came, at, length = [], [0], [(0, 0)], 0, 0
    for start, end, put in changes:
        if start < at:
            continue
        parts += [plain[at:start], put]
        length += start - at
        made.append(length)  # the replacement begins here
        came.append((start, end))
        length += len(put)
        made.append(length)  # and unchanged text goes on
        came.append((end, end))
        at = end
    parts.append(plain[at:])
    copy = "".join(parts)

    def source(place: int, end: bool) -> int:
        i = bisect_right(made, place) - 1
        first, last = came[i]
        if place == made[i]:
            # a span may begin with a replacement; one that ends where it begins ends before it
            return first
        return first + place - made[i] if first == last else (last if end else first)

    found = []
    for start, kind, end in identifiers(copy):
        a, b = source(start, False), source(end, True)
        if text[a:b] != copy[start:end]:
            found.append((a, kind, b))
    return found


def personal_data(text: str) -> tuple[list[Span], list[Span]]:
    """Plain identifiers, and all with the disguised ones that overlap no plain one of their kind."""
    base = identifiers(text)
    more = disguised(text)
    if not more:
        return base, base
    by_kind = {k: [(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))}
    added = []
    for a, kind, b in more:
        own = by_kind[kind]
        i = bisect_right(own, (a, sys.maxsize))
        free = (i == 0 or own[i - 1][1] <= a) and (i == len(own) or own[i][0] >= b)
        if free and a < b:
            added.append((a, kind, b))
    return base, sorted({*base, *added})


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans_array(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in rows], _SPAN_TYPE)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` per row of ``docs``: plain identifiers, and all of them.

    Spans are ``kind, start, end`` in code points, end exclusive, by start and then kind. A null
    or empty text has none; rows that repeat are looked at each for itself; other columns are ignored.
    """
    schema = with_field(docs, id_col, f"base {SPANS}, spans {SPANS}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [personal_data(t or "") for t in batch.column("text").to_pylist()]
            base, every = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _spans_array(base), _spans_array(every)], ["doc_id", "base", "spans"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the plain identifiers by kind, the hash of their spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    hashed = F.sha2(span_text(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *map(count, KINDS), hashed.alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redacted(text: str) -> str:
    """The text with every identifier, plain or disguised, replaced by its kind in brackets."""
    parts, at = [], 0
    for start, kind, end in personal_data(text)[1]:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All documents and columns, without personal data in their texts; ``length_col``, if there is one, is that of the new text."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    done = docs.mapInArrow(put, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        done = done.withColumn(length_col, F.coalesce(F.char_length(text_col).cast(kind), F.col(length_col)))
    return done
