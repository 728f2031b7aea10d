"""Passages that documents share, by compact windows over min-hashes of word shingles.

For a hash function, the position of the least value among the shingles of a stretch stands for it.
A compact window is a position with the widest stretch it is least in; the
windows of a text are the nodes of its Cartesian tree, and every stretch of at least ``least`` shingles lies
in exactly one window that is as long. Windows with the same least shingle and the same
words next to it are joined; what they propose is verified on the texts.

Copies are linked to a representative, first within the tasks that make windows and then over all, so a
passage that many documents have sends few rows. Where a link does not hold as far as a passage can reach beside
the least shingle, the places of that key are linked again, by every stretch of a passage's length around
them: what is equal there is a passage, so no link of the second round stands in another's way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import list_slices, stored, utf8
from tallyframe.llm.simhash import RUN_BASE, mixed, run_hashes

WORDS = 50
SHINGLE = 5
SIMILARITY = 0.8
HASHES = 3
CONTEXTS = (23, 8)  # shingles to either side of the least one that joined windows share
BUFFERED = 250_000  # windows
AROUND = 50_000  # places with the shingles around them
TOGETHER = 1 << 20  # bytes of texts hashed at a time
FEW = 24  # parts of an alignment that are looked at one by one
CELLS = 1 << 22  # shingles compared at a time
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
GAP = 2 * SHINGLE  # shingles that differ inside a passage, at a stretch


def sliding(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest value of every ``size`` neighbours, from stretches that double."""
    wide = 1
    while 2 * wide <= size:
        values = best(values[:-wide], values[wide:])
        wide *= 2
    return values if wide == size else best(values[: len(values) - size + wide], values[size - wide :])


def candidates(values: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are least among some ``least`` neighbours in their text, and the least values of all such stretches.

    The texts follow each other from ``starts``; a stretch that goes on into the next text counts as 0.
    """
    if len(values) < least:
        return np.empty(0, np.int64), np.empty(0, values.dtype)
    low = sliding(values, least, np.minimum)
    for start in starts[1:].tolist():
        low[max(0, start - least + 1) : start] = 0
    pad = np.zeros(least - 1, values.dtype)
    return np.flatnonzero(sliding(np.concatenate([pad, low, pad]), least, np.maximum) == values), low


def window_places(values: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The positions of the windows that ``compact_windows`` gives, for texts that follow each other from ``starts``.

    All candidates have one but those that a value as small stands before, less than ``least`` away: these are
    left out if they are not least from just behind it.
    """
    places, low = candidates(values, starts, least)
    kept = values[places]
    near = np.flatnonzero((kept[1:] == kept[:-1]) & (np.diff(places) < least))
    near = near[np.searchsorted(starts, places[near], "right") == np.searchsorted(starts, places[near + 1], "right")]
    behind = places[near] + 1
    lost = (behind >= len(low)) | (low[np.minimum(behind, len(low) - 1)] != kept[near])
    return np.delete(places, near[lost] + 1)


def compact_windows(values: np.ndarray, least: int) -> np.ndarray:
    """Rows of left end, position and right end of the windows of ``least`` values or more; of equal values the first is least.

    Only values that are least among some ``least`` neighbours can have such a window, and the next smaller
    ones beside such a value are among them too, so the tree is built of these alone.
    """
    n = len(values)
    places, _ = candidates(values, np.zeros(1, np.int64), least)
    left, right = np.empty(len(places), np.int64), np.full(len(places), n, np.int64)
    stack: list[int] = []
    kept = values[places].tolist()
    at = places.tolist()
    for i, v in enumerate(kept):
        while stack and kept[stack[-1]] > v:
            right[stack.pop()] = at[i]
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    wide = right - left >= least
    return np.stack([left[wide], places[wide], right[wide] - 1], 1)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their XXH64 (seed 0), which for words of fewer than 32 bytes is made of all of one length together."""
    buffer = np.frombuffer(text + bytes(8), np.uint8)
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = ~_BLANK[buffer[:-8]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(text) + 1, "<u8", buffer, strides=(1,))
    fours = np.ndarray(len(text) + 1, "<u4", buffer, strides=(1,))
    p1, p2, p3, p4, p5 = _PRIMES
    hashes = np.empty(len(begins), np.uint64)
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(1, 34))
    for size in range(1, 32):
        rows = order[bounds[size - 1] : bounds[size]]
        if not len(rows):
            continue
        at = begins[rows]
        h = np.full(len(rows), p5 + np.uint64(size))
        for i in range(size // 8):
            h = _turned(h ^ _turned(eights[at + 8 * i] * p2, 31) * p1, 27) * p1 + p4
        if size & 4:
            h = _turned(h ^ fours[at + size // 8 * 8].astype(np.uint64) * p1, 23) * p2 + p3
        for i in range(size // 4 * 4, size):
            h = _turned(h ^ buffer[at + i].astype(np.uint64) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        hashes[rows] = h ^ (h >> np.uint64(32))
    for i in order[bounds[31] :].tolist():
        hashes[i] = xxhash.xxh64_intdigest(text[begins[i] : begins[i] + sizes[i]])
    return begins, hashes


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """``run_hashes`` of each text, with the arithmetic done on all together."""
    begins, each = word_hashes(b" ".join(texts).lower())
    ends = np.searchsorted(begins, np.cumsum([len(text) + 1 for text in texts]))
    first = np.append(0, ends)[:-1]
    each = mixed(each, 0)
    runs = np.zeros(max(0, len(each) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        runs = runs * np.uint64(RUN_BASE) + each[i : i + len(runs)]
    runs = mixed(runs, SHINGLE)
    bounds = zip(texts, first.tolist(), (ends - SHINGLE + 1).tolist(), strict=True)
    return [runs[start:past] if past > start else run_hashes(text, SHINGLE) for text, start, past in bounds]


def slices(texts: list[bytes]) -> Iterator[slice]:
    """Neighbouring texts of about ``TOGETHER`` bytes."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TOGETHER:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


_POWERS = np.ones((2, 0), np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, kept for the next text."""
    global _POWERS
    if _POWERS.shape[1] < n:
        _POWERS = np.stack([np.cumprod(np.full(2 * n, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64))])
    return _POWERS[:, :n]


def contexts(hashes: np.ndarray, sums: np.ndarray, places: np.ndarray, start: np.ndarray, past: np.ndarray) -> list[np.ndarray]:
    """Hashes of the shingles to the right and left of the places, whose texts go from ``start`` to ``past``; one of its own where a text ends before.

    ``sums`` are the running sums of the hashes times the powers of the base.
    """
    inverse = powers(len(hashes) + 1)[1]
    found = []
    for size in CONTEXTS:
        for first in (places, places - size + 1):
            inside = (first >= start) & (first + size <= past)
            begin = np.where(inside, first, 0)
            total = (sums[np.minimum(begin + size, len(hashes))] - sums[begin]) * inverse[begin]
            alone = hashes[places] ^ mixed((places - start).astype(np.uint64), size)
            found.append((mixed(np.where(inside, total, alone), size) >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return found


WINDOWS = "part bigint, key bigint, place binary"
PLACE = np.dtype([("near", np.int32, 4), ("doc", np.int64), ("at", np.int32), ("other", np.int64), ("other_at", np.int32)])
NOBODY = -(1 << 62)


def binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row, all of one length."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.nbytes // max(1, len(rows)))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def windows(docs: DataFrame, least: int) -> DataFrame:
    """Windows of all documents (``other`` is ``NOBODY``), and links of those that meet an equal one in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)  # key, r0, l0, r1, l1, doc, at
            rows = rows[np.argsort(rows[:, 0])]
            again = rows[1:, 0] == rows[:-1, 0]
            several = np.append(again, False) | np.append(False, again)
            alone, rows = rows[~several], rows[several]
            rows = np.concatenate([alone, rows[np.lexsort((rows[:, 6], rows[:, 5], rows[:, 2], rows[:, 1], rows[:, 0]))]])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            # links go by their document, so that they spread; windows by their key
            part = np.where(new, rows[:, 0], mixed(rows[:, 5].astype(np.uint64), 7).view(np.int64))
            other = np.where(new, NOBODY, rows[first, 5])
            place = np.empty(len(rows), PLACE)
            place["near"], place["doc"], place["at"] = rows[:, 1:5], rows[:, 5], rows[:, 6]
            place["other"], place["other_at"] = other, np.where(new, 0, rows[first, 6])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(rows[:, 0]), binaries(place)], ["part", "key", "place"])

        for batch in batches:
            ids, texts = np.asarray(batch.column("doc")), batch.column("text").to_pylist()
            for part in slices(texts):
                found = [(doc, hashes) for doc, hashes in zip(ids[part].tolist(), hashed(texts[part]), strict=True) if len(hashes) >= least]
                if not found:
                    continue
                own = np.array([doc for doc, _ in found])
                ends = np.cumsum([len(hashes) for _, hashes in found])
                starts = np.concatenate([[0], ends[:-1]])
                hashes = np.concatenate([hashes for _, hashes in found])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes) + 1)[0, :-1])])
                for number in range(HASHES):
                    values = mixed(hashes, 11 + number)
                    places = window_places(values, starts, least)
                    text = np.searchsorted(starts, places, "right") - 1
                    key = mixed(values[places], 31 + number).view(np.int64)
                    near = contexts(hashes, sums, places, starts[text], ends[text])
                    rows = np.stack([key, *near, own[text], places - starts[text]], 1)
                    held.append(rows)
                    count += len(rows)
            if count >= BUFFERED:
                yield flush()
                count = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, WINDOWS)


def whole_keys(batches: Iterator[pa.RecordBatch], unpack: Callable[[pa.RecordBatch], np.ndarray], buffered: int) -> Iterator[np.ndarray]:
    """The rows of batches in order of their first column, in parts that cut none of its values in two."""
    carried: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        carried.append(unpack(batch))
        size += len(carried[-1])
        if size >= buffered and carried[-1][-1, 0] != carried[0][0, 0]:
            rows = np.concatenate(carried)
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
            carried, size = [rows[cut:].copy()], len(rows) - cut
            yield rows[:cut]
    if carried:
        yield np.concatenate(carried)


def columns_of(names: list[str]) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names], 1)


def to_first(key: np.ndarray, value: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of document, first document, place, first place and key of all rows after the first with the same key and value."""
    order = np.lexsort((at, doc, value, key))
    key, value, doc, at = key[order], value[order], doc[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.stack([doc, doc[first], at, at[first], key], 1)[~new]


def different(rows: np.ndarray) -> np.ndarray:
    """The different rows, in order of the last column, then the one before and so on."""
    rows = rows[np.lexsort(rows.T)]
    return rows[np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(1)])]


LINKS = "doc bigint, other bigint, places array<struct<at int, other_at int, key bigint>>"


def link_batch(links: list[np.ndarray]) -> pa.RecordBatch:
    """The different links (document, other, place, place in the other, key), by documents; those to the document itself also by key."""
    rows = different(np.concatenate(links)[:, [3, 2, 4, 1, 0]])[:, [4, 3, 1, 0, 2]]
    new = (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 0] == rows[1:, 1]) & (rows[1:, 4] != rows[:-1, 4])
    pairs = np.flatnonzero(np.append(np.ones(min(1, len(rows)), bool), new))
    fields = [pa.array(rows[:, i].astype(t)) for i, t in ((2, np.int32), (3, np.int32), (4, np.int64))]
    places = pa.StructArray.from_arrays(fields, ["at", "other_at", "key"])
    places = pa.ListArray.from_arrays(pa.array(np.append(pairs, len(rows)).astype(np.int32)), places)
    return pa.RecordBatch.from_arrays([pa.array(rows[pairs, 0]), pa.array(rows[pairs, 1]), places], ["doc", "other", "places"])


def linked(found: DataFrame) -> DataFrame:
    """Documents of joined windows and their places (``LINKS``); also, linked to themselves, the
    places of joined windows of one document, which are not compared but linked again."""

    def unpacked(batch: pa.RecordBatch) -> np.ndarray:
        place = np.frombuffer(b"".join(batch.column("place").to_pylist()), PLACE)
        return np.column_stack([np.asarray(batch.column("key")), *(place[name] for name in PLACE.names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, unpacked, BUFFERED):
            made, alone = rows[rows[:, 7] != NOBODY], rows[rows[:, 7] == NOBODY]
            several = np.zeros(len(alone), bool)
            several[1:] = alone[1:, 0] == alone[:-1, 0]
            several[:-1] |= several[1:]
            alone = alone[several]
            out = [made[:, [5, 7, 6, 8, 0]]]
            out += [to_first(alone[:, 0], alone[:, context], alone[:, 5], alone[:, 6]) for context in (1, 2, 3, 4)]
            links = np.concatenate(out)
            own = links[links[:, 0] == links[:, 1]]
            yield link_batch([links[links[:, 0] != links[:, 1]], own[:, [0, 1, 2, 2, 4]], own[:, [0, 1, 3, 3, 4]]])

    return found.repartition("part").drop("part").sortWithinPartitions("key").mapInArrow(run, LINKS)


def doubtful(marks: DataFrame) -> DataFrame:
    """``(key, doc, ats)``: the places of keys that have three or more in several documents, one of them with a link that did not hold all round."""

    def unpacked(batch: pa.RecordBatch) -> np.ndarray:
        offsets, ats = list_slices(batch.column("ats"))
        return np.column_stack([columns_of(["key", "doc", "open"])(batch).repeat(np.diff(offsets), 0), np.asarray(ats)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, unpacked, BUFFERED):
            unsure = np.unique(rows[rows[:, 2] > 0, 0])
            places = different(rows[:, [3, 1, 0]])[:, ::-1]
            _, first, number, counts = np.unique(places[:, 0], return_index=True, return_inverse=True, return_counts=True)
            several = places[first, 1] != places[first + counts - 1, 1]
            keep = ((counts >= 3) & several)[number] & np.isin(places[:, 0], unsure)
            yield place_lists(places[keep])

    return marks.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, doc bigint, ats array<int>")


def place_lists(places: np.ndarray) -> pa.RecordBatch:
    """Sorted rows of key, document and place as one row for each key and document."""
    new = np.flatnonzero(np.append(np.ones(min(1, len(places)), bool), (places[1:, :2] != places[:-1, :2]).any(1)))
    ats = pa.ListArray.from_arrays(pa.array(np.append(new, len(places)).astype(np.int32)), pa.array(places[:, 2].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(places[new, 0]), pa.array(places[new, 1]), ats], ["key", "doc", "ats"])


def linked_again(places: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Links of places by the shingles around them: every stretch of ``least`` that holds the place, and shorter ones that begin or end with it."""
    reach = least - 1
    wide = 2 * reach + 1

    def surroundings(doc: int, hashes: np.ndarray, ats: np.ndarray) -> np.ndarray:
        """The shingles around the places; values of its own where the text ends before."""
        near = np.empty((len(ats), wide), np.uint64)
        inner = (ats >= reach) & (ats + reach < len(hashes))
        if inner.any():
            near[inner] = np.lib.stride_tricks.sliding_window_view(hashes, wide)[ats[inner] - reach]
        for i in np.flatnonzero(~inner).tolist():
            near[i] = mixed(np.arange(wide, dtype=np.uint64) + np.uint64(xxhash.xxh64_intdigest(f"{doc} {ats[i]}")), 5)
            at = ats[i] - reach + np.arange(wide)
            known = (at >= 0) & (at < len(hashes))
            near[i, known] = hashes[at[known]]
        return near

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of a key and a document that have the same around them are one row."""
        for batch in batches:
            offsets, flat = list_slices(batch.column("places"))
            bounds, all_ats = list_slices(flat.field("ats"))
            all_keys, all_ats = np.repeat(np.asarray(flat.field("key")), np.diff(bounds)), np.asarray(all_ats).astype(np.int64)
            offsets = bounds[offsets]
            docs, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
            for part in slices(texts):
                out: list[tuple] = []
                size = 0
                for n, hashes in zip(range(part.start, part.stop), hashed(texts[part]), strict=True):
                    for first in range(offsets[n], offsets[n + 1], AROUND // 2):
                        places = slice(first, min(offsets[n + 1], first + AROUND // 2))
                        keys, ats = all_keys[places], all_ats[places]
                        near = surroundings(docs[n], hashes, ats)
                        order = np.lexsort((ats, (near * powers(wide)[0]).sum(1), keys))
                        keys, ats, near = keys[order], ats[order], near[order]
                        new = np.ones(len(ats), bool)
                        new[1:] = (keys[1:] != keys[:-1]) | (near[1:] != near[:-1]).any(1)
                        out.append((docs[n], keys[new], ats, np.flatnonzero(new), near[new]))
                        size += int(new.sum())
                        if size >= AROUND // 2:
                            yield packed(out)
                            out, size = [], 0
                if size:
                    yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        counts = np.concatenate([np.diff(np.append(new, len(ats))) for _, _, ats, new, _ in out])
        lists = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        near = np.concatenate([o[4] for o in out])
        columns = [pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([np.full(len(o[1]), o[0]) for o in out]))]
        columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate([o[2] for o in out]).astype(np.int32))))
        columns.append(binaries(near))
        return pa.RecordBatch.from_arrays(columns, ["key", "doc", "ats", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.empty(0, np.int64)]  # places of the rows that are not yet linked

        def unpacked(batch: pa.RecordBatch) -> np.ndarray:
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            sums = np.cumsum(near * powers(wide)[0], axis=1).view(np.int64)
            offsets, ats = list_slices(batch.column("ats"))
            waiting.append(np.asarray(ats).astype(np.int64))
            counts = np.diff(offsets).astype(np.int64)[:, None]
            return np.concatenate([columns_of(["key", "doc"])(batch), waiting[-1][offsets[:-1], None], counts, sums], 1)

        for rows in whole_keys(batches, unpacked, AROUND):
            counts = rows[:, 3]
            ats = np.concatenate(waiting)
            waiting[:] = [ats[counts.sum() :]]
            begins = np.cumsum(counts) - counts
            order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.arange(len(rows))
            sums = rows[:, 3:].view(np.uint64)  # of the shingles up to each; the column before them is not read
            own, doc = mixed(rows[:, 0].view(np.uint64), 3), rows[:, 1].copy()
            ends = [(i, i + least) for i in range(reach + 1)]
            for size in range(min(CONTEXTS), least):
                ends += [(reach, reach + size), (reach + 1 - size, reach + 1)]
            found = [np.empty((0, 2), np.int64)]
            last = rank.copy()
            first = np.empty(len(rows), np.int64)
            for begin, past in ends:
                value = (sums[:, past] - sums[:, begin] if begin else sums[:, past]) ^ own
                by = np.argsort(value)
                value = value[by]
                new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                first[by] = np.repeat(np.minimum.reduceat(rank[by], new), np.diff(np.append(new, len(rows))))
                changed = np.flatnonzero(first != last)
                changed = changed[doc[order[first[changed]]] != doc[changed]]
                found.append(np.stack([order[first[changed]], changed], 1))
                last[:] = first
            firsts, all_rows = different(np.concatenate(found)).T
            links_of = np.cumsum(counts[all_rows])
            done = 0
            while done < len(all_rows):  # so many links at a time, as a place may have one by each stretch
                before = int(links_of[done - 1]) if done else 0
                past = max(done + 1, int(np.searchsorted(links_of, before + BUFFERED, "right")))
                first, row = firsts[done:past], all_rows[done:past]
                many = counts[row]
                at = ats[np.repeat(begins[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                links = np.stack([doc[row], doc[first], rows[row, 0], rows[first, 2]], 1).repeat(many, 0)
                links = np.concatenate([at[:, None] - links[:, 3:], links, at[:, None]], 1)  # shift, doc, other, key, other_at, at
                links = links[np.lexsort((links[:, 0], links[:, 2], links[:, 1]))]
                new = np.ones(len(links), bool)  # one link of two documents and a shift will do
                new[1:] = (links[1:, :3] != links[:-1, :3]).any(1)
                yield link_batch([links[new][:, [1, 2, 5, 4, 3]]])
                done = past

    by_doc = places.groupBy("doc").agg(F.collect_list(F.struct("key", "ats")).alias("places"))
    near = by_doc.join(rows, "doc").mapInArrow(around, "key bigint, doc bigint, ats array<int>, near binary")
    return near.repartition("key").sortWithinPartitions("key").mapInArrow(run, LINKS)


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays begin with in common."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        past = min(n, at + size)
        differs = a[at:past] != b[at:past]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, size = past, size * 4
    return n


def extended(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal stretches (first in either array, length) that follow each other from the start, up to ``GAP`` values apart in both."""
    found: list[tuple[int, int, int]] = []
    i = j = 0
    while True:
        near = a[i : i + GAP + 1, None] == b[None, j : j + GAP + 1]
        if not near.any():
            return found
        begins = near.copy()
        begins[1:, 1:] &= ~near[:-1, :-1]
        best = None
        for x, y in np.argwhere(begins).tolist():
            length = alike(a[i + x :], b[j + y :])
            worth = (min(length, 2 * GAP) - max(x, y), -abs(x - y))
            if best is None or worth > best[0]:
                best = worth, x, y, length
        _, x, y, length = best
        found.append((i + x, j + y, length))
        i, j = i + x + length, j + y + length


def stretches(parts: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The widest sequences of equal parts (first in either text, length; in order) that are long and similar enough."""
    if len(parts) <= FEW:
        return few_stretches(parts.tolist(), least, similarity)
    ends, sums = parts[:, :2] + parts[:, 2:], np.cumsum(parts[:, 2])
    found, reached = [], -1
    for i in range(len(parts)):
        size = ends[i:] - parts[i, :2]
        same = sums[i:] - sums[i] + parts[i, 2]
        jaccard = same / (size.sum(1) - same)
        good = np.flatnonzero((size.min(1) >= least) & (jaccard >= similarity))
        if len(good) and i + good[-1] > reached:
            k = good[-1]
            reached = i + int(k)
            found.append((int(parts[i, 0]), int(ends[reached, 0]), int(parts[i, 1]), int(ends[reached, 1]), float(jaccard[k])))
        if reached == len(parts) - 1:
            break
    return found


def few_stretches(parts: list, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """``stretches`` of a few parts."""
    found, reached, last = [], -1, len(parts) - 1
    whole = sum(n for _, _, n in parts)
    for i, (x, y, _) in enumerate(parts):
        same = whole
        for k in range(last, max(i, reached + 1) - 1, -1):
            x_past, y_past = parts[k][0] + parts[k][2], parts[k][1] + parts[k][2]
            jaccard = same / (x_past - x + y_past - y - same)
            if min(x_past - x, y_past - y) >= least and jaccard >= similarity:
                reached = k
                found.append((x, x_past, y, y_past, jaccard))
                break
            same -= parts[k][2]
        if reached == last:
            break
        whole -= parts[i][2]
    return found


def diagonals(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Equal stretches (first in either text, length) of two texts shifted against each other, in order of ``shifts``."""
    start, end = np.maximum(0, shifts), np.minimum(len(a), len(b) + shifts)
    shifts, start, end = (x[start < end] for x in (shifts, start, end))
    at = np.cumsum(end - start + 1)
    found = [np.empty((0, 3), np.int64)]
    done = 0
    while done < len(shifts):
        before = int(at[done - 1]) if done else 0
        past = max(done + 1, int(np.searchsorted(at, before + CELLS, "right")))
        same = np.zeros(int(at[past - 1]) - before + 1, bool)  # one that is not equal before, between and after them
        offsets = np.concatenate([[0], at[done : past - 1] - before]) + 1
        for o, s, x, y in zip(offsets.tolist(), shifts[done:past].tolist(), start[done:past].tolist(), end[done:past].tolist(), strict=True):
            np.equal(a[x:y], b[x - s : y - s], out=same[o : o + y - x])
        edges = np.flatnonzero(same[1:] != same[:-1]) + 1
        firsts, lengths = edges[::2], edges[1::2] - edges[::2]
        which = np.searchsorted(offsets, firsts, "right") - 1
        firsts = firsts - offsets[which] + start[done:past][which]
        found.append(np.stack([firsts, firsts - shifts[done:past][which], lengths], 1))
        done = past
    return np.concatenate(found)


def joined(a: np.ndarray, b: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which parts have another one within ``GAP`` of an end of theirs: ``extended`` finds nothing for the others."""
    size = GAP + 1
    x = np.concatenate([np.full(size, 1, np.uint64), a, np.full(size, 1, np.uint64)])
    y = np.concatenate([np.full(size, 2, np.uint64), b, np.full(size, 2, np.uint64)])
    x, y = (np.ndarray((len(z) - size + 1, size), z.dtype, z, strides=(8, 8)) for z in (x, y))
    found = np.zeros(len(parts), bool)
    for i in range(0, len(parts), 4096):
        first, other, length = parts[i : i + 4096].T
        for p, q in ((first, other), (first + length + size, other + length + size)):
            found[i : i + 4096] |= (x[p][:, :, None] == y[q][:, None, :]).any((1, 2))
    return found


def aligned(a: np.ndarray, b: np.ndarray, parts: np.ndarray, words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Verified passages: first and past word in the one text, first and past word in the other, similarity.

    An alignment starts on one of the parts, which come from ``diagonals``, and goes on over gaps to whatever diagonal the texts are equal on next.
    """
    least = words - SHINGLE + 1
    enough = 2 * least * similarity / (1 + similarity) - 1  # equal shingles that any passage has
    near = joined(a, b, parts)
    whole = parts[~near & (parts[:, 2] >= least)]
    found = {(x, x + n, y, y + n, 1.0) for x, y, n in whole.tolist()}
    parts = parts[near]
    if len(parts):
        firsts, shifts = parts[:, 0], parts[:, 0] - parts[:, 1]
        apart = (shifts[1:] != shifts[:-1]) | (firsts[1:] - firsts[:-1] - parts[:-1, 2] > GAP)
        begins = np.flatnonzero(np.append(True, apart))
        totals = np.add.reduceat(parts[:, 2], begins)
        pasts = np.append(begins[1:], len(parts))
        for i in np.flatnonzero(totals >= enough).tolist():  # on one diagonal
            found.update(stretches(parts[begins[i] : pasts[i]], least, similarity))
    seen: dict[int, list[tuple[int, int]]] = {}
    for first, other, length in parts.tolist():
        if any(x <= first and first + length <= y for x, y in seen.get(first - other, ())):
            continue
        before = [(first - x - n, other - y - n, n) for x, y, n in extended(a[:first][::-1], b[:other][::-1])]
        after = [(first + length + x, other + length + y, n) for x, y, n in extended(a[first + length :], b[other + length :])]
        run = [*before[::-1], (first, other, length), *after]
        for x, y, n in run:
            seen.setdefault(x - y, []).append((x, x + n))
        if sum(n for _, _, n in run) >= enough:
            found.update(few_stretches(run, least, similarity) if len(run) <= FEW else stretches(np.array(run), least, similarity))
    widest = sorted(found, key=lambda f: (f[0] - f[1], f[2] - f[3], -f[4]))
    if len(widest) > 1:
        first, past, other, other_past = np.array([f[:4] for f in widest], np.int32).T[:, None, :]
        kept = []
        step = max(1, CELLS // len(widest))
        for i in range(0, len(widest), step):
            inner = (x[0, i : i + step, None] for x in (first, past, other, other_past))
            x, x_past, y, y_past = inner
            within = (first <= x) & (x_past <= past) & (other <= y) & (y_past <= other_past)
            kept.append(~np.tril(within, i - 1).any(1))
        widest = [f for f, keep in zip(widest, np.concatenate(kept).tolist(), strict=True) if keep]
    return [(x, past + SHINGLE - 1, y, other_past + SHINGLE - 1, value) for x, past, y, other_past, value in widest]


def shared(a: np.ndarray, b: np.ndarray, shifts: list[int], words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """``aligned`` passages of the shifted texts."""
    return aligned(a, b, diagonals(a, b, np.array(shifts, np.int64)), words, similarity)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """Passages of ``words`` words or more that a document has in common with another.

    Returns ``doc_id, first_word, past_word, other_id, other_first_word, similarity``, both ways round: a passage of
    several documents is linked to representatives, not in all pairs. Words are what ASCII white space parts, A-Z
    in lower case; passages keep their order and may differ in single words, also by words put in or left out, as long as their
    5-word shingles have a Jaccard similarity of ``similarity`` or more. Ids are integers; rows without an id or a
    text take no part, nor do rows that repeat an id count as another document. Other columns are ignored.
    """
    least = words - SHINGLE + 1
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc"), utf8(text_col).alias("text")
    )
    links = stored(linked(windows(rows, least)), "passage-links")
    found = stored(verified(links, rows, words, similarity, marked=True), "passages")
    own = links.where("doc = other").selectExpr("places[0].key as key", "doc", "places.at as ats", "true as open")
    places = found.where("key is not null").selectExpr("key", "doc_id as doc", "ats", "past_word > 0 as open")
    shifts = [df.where("doc <> other").selectExpr("doc", "other", "inline(places)") for df in (linked_again(doubtful(own.unionByName(places)), rows, least), links)]
    new, known = (df.withColumn("shift", F.expr("at - other_at")) for df in shifts)
    again = new.join(known.select("doc", "other", "shift"), ["doc", "other", "shift"], "left_anti")
    again = stored(again.select("doc", "other", F.array(F.struct("at", "other_at", "key")).alias("places")), "passage-links-again")
    more = verified(again, rows, words, similarity, marked=False)
    return found.where("key is null").unionByName(more).drop("key", "ats").distinct()


def verified(links: DataFrame, rows: DataFrame, words: int, similarity: float, marked: bool) -> DataFrame:
    """Passages of linked documents, both ways round (``key`` is null).

    Also, if they are to be marked, the places ``ats`` of links by ``key`` and document: ``past_word`` is 1 if the texts
    differ as near to one of them as a passage of just ``words`` words may reach.
    """
    least = words - SHINGLE + 1
    pairs = links.where("doc <> other").groupBy("doc", "other").agg(F.flatten(F.collect_list("places")).alias("places"))
    left = pairs.join(rows, "doc")
    both = left.join(rows.select(F.col("doc").alias("other"), F.col("text").alias("other_text")), "other")

    def differ(size: int, parts: np.ndarray, at: np.ndarray, other_at: np.ndarray) -> np.ndarray:
        parts = np.concatenate([[[-1, -1, 0]], parts])
        # shift and place in one number: both are below 2**31
        ends = (parts[:, 0] - parts[:, 1] << 32) + parts[:, 0]
        ends[0] = np.iinfo(np.int64).min
        part = parts[np.searchsorted(ends, (at - other_at << 32) + at, "right") - 1]
        held = (part[:, 0] - part[:, 1] == at - other_at) & (part[:, 0] <= np.maximum(0, at - least + 1))
        return ~held | (part[:, 0] + part[:, 2] < np.minimum(size, at + least))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, batch.num_rows, TOGETHER >> 12):
                made = verify_some(batch.slice(n, TOGETHER >> 12))
                if made is not None:
                    yield made

    def verify_some(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, marks = [], [np.empty((0, 4), np.int64)]
        docs, others, texts, other_texts = (batch.column(c).to_pylist() for c in ("doc", "other", "text", "other_text"))
        offsets, flat = list_slices(batch.column("places"))
        at, other_at, key = (np.asarray(flat.field(c)).astype(np.int64) for c in ("at", "other_at", "key"))
        known = list(dict.fromkeys([*texts, *other_texts]))
        hashes = dict(zip(known, chain.from_iterable(hashed(known[part]) for part in slices(known)), strict=True))
        for n, (doc, other, text, other_text) in enumerate(zip(docs, others, texts, other_texts, strict=True)):
            own = slice(offsets[n], offsets[n + 1])
            a, b = hashes[text], hashes[other_text]
            parts = diagonals(a, b, np.unique(at[own] - other_at[own]))
            for first, past, other_first, other_past, value in aligned(a, b, parts, words, similarity):
                out.append((doc, first, past, other, other_first, value))
                out.append((other, other_first, other_past, doc, first, value))
            if marked:
                apart = differ(len(a), parts, at[own], other_at[own])
                whole = np.ones(len(apart), np.int64)
                mine = np.stack([key[own], doc * whole, at[own], whole], 1)[apart]
                marks.append(np.concatenate([mine, np.stack([key[own], other * whole, other_at[own], 0 * whole], 1)]))
        marked_places = different(np.concatenate(marks)[:, ::-1])[:, ::-1]  # key, document, place, open
        places = place_lists(marked_places)
        n = places.num_rows
        if not out and not n:
            return None
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
        passages = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        lists = places.column("ats")
        unsure = np.maximum.reduceat(marked_places[:, 3], list_slices(lists)[0][:-1]).astype(np.int32) if n else np.empty(0, np.int32)
        others = [places.column("doc"), pa.nulls(n, pa.int32()), pa.array(unsure), *(pa.nulls(n, k) for k in kinds[3:])]
        filled = [pa.concat_arrays([x, y]) for x, y in zip(passages, others, strict=True)]
        filled.append(pa.concat_arrays([pa.nulls(len(out), pa.int64()), places.column("key")]))
        filled.append(pa.concat_arrays([pa.nulls(len(out), lists.type), lists]))
        return pa.RecordBatch.from_arrays(filled, [*PASSAGE, "key", "ats"])

    schema = "doc_id bigint, first_word int, past_word int, other_id bigint, other_first_word int, similarity double, key bigint, ats array<int>"
    return both.mapInArrow(verify, schema)


PASSAGE = ["doc_id", "first_word", "past_word", "other_id", "other_first_word", "similarity"]
