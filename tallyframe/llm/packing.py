"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Hierarchical residual packing: every partition packs its own pieces by best fit
and emits the bins that are nearly full. The underfull bins become the items of
the next round; the bins of several neighbouring partitions meet there and are
packed again, as wholes, by best fit. Rounds go on until one group is left, or
as few groups as the bound on the items of a task allows.

Only one row per underfull bin takes part in the rounds. Pieces move once, in
the last join, and only as numbers: texts and token ids stay where they are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import claim_worker, stored, utf8, with_field

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SLACK = 16  # a bin with this little room left is final
FAN_IN = 8  # groups that merge into one in a round
GROUP_ITEMS = 200_000  # underfull bins that one task may pack
BUFFERED_PIECES = 200_000  # pieces packed together in the first round
CACHED_WORDS = 600_000
CACHED_BYTES = 64  # longer words are not kept
# UTF-8 lead bytes of the accents that combine with ASCII letters, and the beginning of special tokens
_KEEP_CASE = (b"\xcc", b"\xcd", b"<|")
_ENDING_SIGNS = re.compile(rb"(?<=[a-zA-Z])([.,;:!?#$%&*]+)(?=[ \t-\r]|$)")

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer never lets a token cross white space, so ids are looked up
    per word; the table of known words is bounded and starts anew when full.
    Words are split at ASCII white space only; any other white space stays
    inside a chunk, where the tokenizer sees to it.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def __call__(self, text: bytes) -> bytes:
        words = self.words(text)
        found = list(map(self.known.get, words))
        try:
            return b"".join(found)
        except TypeError:
            pass
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list({w for w, ids in zip(words, found, strict=True) if ids is None})
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        ids = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(new, encoded, strict=True)}
        self.known.update((w, x) for w, x in ids.items() if len(w) <= CACHED_BYTES)
        return b"".join([ids[w] if x is None else x for w, x in zip(words, found, strict=True)])

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """Words in a form that repeats often: lower case, without the signs that end them.

        The tokenizer lowers case and parts signs from letters itself, after it has composed
        characters. So capitals stay where an accent may follow one, and where a special token may be written.
        """
        if not any(x in text for x in _KEEP_CASE):
            text = text.lower()
        return _ENDING_SIGNS.sub(rb" \1", text).split()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, so tasks share the known words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place in the bin of every item, by best fit, longest first.

    Open bins are kept by the room they have; a bit set of the rooms in use gives
    the smallest that is large enough.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = int(np.count_nonzero(lengths == capacity))
    bins[order[:whole]] = np.arange(whole)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, whole
    for i in order[whole:].tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        if room > length:
            by_room[room - length].append(b)
            rooms |= 1 << (room - length)
    return bins, offsets


def pack_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    """First round: pieces of documents, packed within their partition. ``fill`` is that of the bin."""
    schema = with_field(docs, id_col, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("packing", _ENCODERS.clear)
        encode = encoder(tokenizer)
        next_bin = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            nonlocal next_bin
            ids = pa.concat_arrays([x for x, _ in held])
            rows = np.concatenate([x for _, x in held])
            bins, offsets = best_fit(rows[:, 2], capacity)
            fill = np.bincount(bins, rows[:, 2]).astype(np.int64)[bins]
            columns = [rows[:, 0].astype(np.int32), *rows[:, 1:].T, bins + next_bin, offsets, fill]
            next_bin += int(bins.max()) + 1
            held.clear()
            return pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, columns)], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
            )

        count = 0
        for batch in batches:
            owners, rows = [], []
            for i, text in enumerate(batch.column("text")):
                data = encode(text.as_py()) + b"\0\0\0\0"
                total = len(data) >> 2
                for piece, start in enumerate(range(0, total, capacity)):
                    part = memoryview(data)[4 * start : 4 * (start + capacity)]
                    owners.append(i)
                    rows.append((piece, start, len(part) >> 2, zlib.crc32(part)))
            if rows:
                held.append((batch.column("doc_id").take(pa.array(owners)), np.array(rows, np.int64)))
                count += len(rows)
            if count >= BUFFERED_PIECES:
                yield packed()
                count = 0
        if held:
            yield packed()

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, schema)


def merge_bins(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """One round: ``(bin, fill)`` of neighbouring bins to ``(bin, into, at, into_fill)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("bin")), np.asarray(b.column("fill"))) for b in batches if b.num_rows]
        if not parts:
            return
        ids, fills = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(ids)
        ids, fills = ids[order], fills[order]
        bins, at = best_fit(fills, capacity)
        names = np.empty(int(bins.max()) + 1, np.int64)
        first = at == 0
        names[bins[first]] = ids[first]  # a merged bin is called as its first item
        total = np.bincount(bins, fills).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids, names[bins], at, total[bins])], ["bin", "into", "at", "into_fill"]
        )

    ranged = items.repartitionByRange(groups, "bin")
    return ranged.mapInArrow(run, "bin bigint, into bigint, at bigint, into_fill bigint")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    slack: int = SLACK,
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its token ids and a closing id 0; a null or empty text is that
    0 alone. Only documents longer than ``capacity`` are cut, into full pieces and a
    rest. Repeated rows are packed as often as they occur, null ids are kept,
    other columns are ignored. An empty table gives no rows.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    pieces = stored(pack_pieces(docs, id_col, text_col, path, capacity), "pieces")
    bins = pieces.where(F.col("offset") == 0).select("bin", "fill")
    items = bins.where(F.col("fill") < capacity - slack)
    seen = items.agg(F.count(F.lit(1)), F.count_distinct(F.shiftright("bin", 33))).first()
    count, groups, moved = seen[0], max(1, seen[1]), None
    while count > 1:
        floor = -(-count // GROUP_ITEMS)
        groups = max(-(-groups // FAN_IN), floor)
        merged = stored(merge_bins(items, groups, capacity), "merged")
        if moved is None:
            moved = merged.select("bin", "into", "at")
        else:
            step = merged.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("at").alias("_at"))
            moved = moved.join(step, "into", "left").select(
                "bin", F.coalesce("_into", "into").alias("into"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at")
            )
        items = merged.where((F.col("at") == 0) & (F.col("into_fill") < capacity - slack)).select(
            F.col("into").alias("bin"), F.col("into_fill").alias("fill")
        )
        count = items.count()
        if groups == floor:
            break
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moved, "bin", "left").select(
        *out,
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"),
    )
