"""Exact top-k inner products by no-random-access aggregation of sorted lists.

A score is a sum over dimensions, so every dimension is a sorted list of its
vectors, read from the end that suits the sign of the query. While the lists are
read in step, a vector has a lower bound (what is read, and the least that
each unread list can give) and an upper bound (what is read, and the next value of each unread
list). Reading stops when few enough vectors have an upper bound that reaches the k-th
lower bound; the scores of these are then resolved exactly.

Vectors are dealt to tiles, queries to parts, and every tile meets every part in a group of its own.
A group takes its vectors one block after the other: a block is sorted once for all queries, and the k-th
score that a query has by then is its bar for the next block. Rows travel one by one, so no row, batch
or task holds more than a part of the queries and a block of vectors. k rows per query and group are left to be ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import list_slices, stored

BLOCK = 4096  # vectors
QUERY_BLOCK = 512
CHUNK = 1024  # entries of every list that are read before bounds are compared
RESOLVED = 256  # so many candidates are resolved rather than read on for
EXACT = 1 << 52  # sums of products of whole numbers below are exact in doubles
EXACT_SINGLE = 1 << 23  # and these in floats
GROUP_PAIRS = 1 << 27  # pairs of a query and a vector that are worth a group
GROUPS = 192  # at most, unless the queries need more parts
TILES = 64  # a query's rows are sent and returned so many times at most
PART = 1 << 18  # queries that a task holds
GATHERED = 1 << 14  # pairs that are resolved at a time
SPREAD = 1.5  # standard deviations that leave about as many of a block as are resolved


def finite(vector: str | Column) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    column = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def packed(rows: pa.Array) -> pa.Array:
    """Whole-number vectors as bytes: the size of a component (2, 4 or 8, what the vector needs), and the components."""
    at, values = list_slices(rows)
    flat = np.asarray(values).astype(np.int64, copy=False)
    wide = np.where((flat >= -(1 << 15)) & (flat < 1 << 15), 2, np.where((flat >= -(1 << 31)) & (flat < 1 << 31), 4, 8)).astype(np.int8)
    sizes, n = np.diff(at), len(at) - 1
    if n and (sizes == sizes[0]).all() and len(flat) and (wide <= 2).all():
        out = np.empty((n, 1 + 2 * sizes[0]), np.uint8)
        out[:, 0] = 2
        out[:, 1:] = flat.astype("<i2").reshape(n, -1).view(np.uint8)
        ends = pa.array(np.arange(n + 1) * out.shape[1], pa.int64()).buffers()[1]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, ends, pa.py_buffer(out)]).cast(pa.binary())
    found = []
    for i in range(n):
        size = int(wide[at[i] : at[i + 1]].max(initial=2))
        found.append(bytes([size]) + flat[at[i] : at[i + 1]].astype(f"<i{size}").tobytes())
    return pa.array(found, pa.binary())


def unpacked(rows: pa.Array) -> np.ndarray:
    """Packed vectors as the rows of a matrix; missing components are 0."""
    raw = rows.to_pylist()
    sizes = {r[0] for r in raw}
    lengths = {len(r) for r in raw}
    if len(sizes) == 1 and len(lengths) == 1:
        size, length = sizes.pop(), lengths.pop()
        data = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), length)
        return np.ascontiguousarray(data[:, 1:]).view(f"<i{size}").reshape(len(raw), (length - 1) // size)
    out = np.zeros((len(raw), max(((len(r) - 1) // r[0] for r in raw), default=0)), f"<i{max(sizes, default=2)}")
    for i, r in enumerate(raw):
        out[i, : (len(r) - 1) // r[0]] = np.frombuffer(r, f"<i{r[0]}", offset=1)
    return out


def widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def stacked(pieces: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in pieces)
    return np.concatenate([widened(p, width) for p in pieces])


class SortedLists:
    """The vectors of a block by id, and the values of every dimension in order."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order].astype(np.int64), ids[order]
        self.values = np.sort(self.vectors, axis=0).astype(np.float64)
        self.most = np.abs(self.values[[0, -1]]).max(0)
        self._read: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._known: dict[type, np.ndarray] = {}

    def known(self, kind: type) -> np.ndarray:
        if kind not in self._known:
            self._known[kind] = self.vectors.astype(kind)
        return self._known[kind]

    def read(self, depth: int, upper: bool, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each vector can give in every list once ``depth`` entries are read, from the large and the small ends, with means and variances.

        A component beyond the next value of its list has been read; of the others the list only says that they are up to that value.
        """
        if (depth, upper, kind) not in self._read:
            known, values, n = self.known(kind), self.values.astype(kind), len(self.ids)
            if depth >= n:
                ends = known, known
            elif upper:
                ends = np.maximum(known, values[n - 1 - depth]), np.minimum(known, values[depth])
            else:
                ends = np.where(known > values[n - 1 - depth], known, values[0]), np.where(known < values[depth], known, values[-1])
            both = np.concatenate(ends, axis=1)
            self._read[depth, upper, kind] = np.ascontiguousarray(both.T), both.mean(0, np.float64), both.var(0, dtype=np.float64)
        return self._read[depth, upper, kind]

    def bounds(self, depth: int, upper: bool, weights: np.ndarray) -> np.ndarray:
        """Largest or least scores of all vectors (queries x vectors) once ``depth`` entries of every list are read."""
        if depth >= len(self.ids):
            return weights @ self.read(depth, upper, weights.dtype.type)[0][: weights.shape[1]]
        return self.sides(weights) @ self.read(depth, upper, weights.dtype.type)[0]

    @staticmethod
    def sides(weights: np.ndarray) -> np.ndarray:
        """The weights above zero, whose lists are read from the large end, and those below."""
        return np.concatenate([np.maximum(weights, 0), np.minimum(weights, 0)], axis=1)

    def usual(self, depth: int, upper: bool, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation that the bounds of each query would have if dimensions were independent."""
        _, means, variances = self.read(depth, upper, weights.dtype.type)
        sides = self.sides(weights).astype(np.float64)
        return sides @ means, np.sqrt(sides**2 @ variances)


class Best:
    """The queries of a part and the ``k`` best that each has met, best first, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, chunk: int, resolved: int, query_block: int) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.chunk, self.resolved, self.query_block = chunk, resolved, query_block
        self.count = np.zeros(len(own), np.int64)
        self.scores = np.zeros((len(own), k), np.int64)
        self.ids = np.zeros((len(own), k), np.int64)

    def meet(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """All queries meet a block of vectors."""
        width = max(vectors.shape[1], self.queries.shape[1])
        self.queries = widened(self.queries, width)
        lists = SortedLists(widened(vectors, width), ids)
        for start in range(0, len(self.own), self.query_block):
            self._search(lists, start, min(start + self.query_block, len(self.own)))

    def _search(self, lists: SortedLists, start: int, stop: int) -> None:
        """The lists are read in step for all queries that are still open."""
        n, k = len(lists.ids), self.k
        queries = self.queries[start:stop].astype(np.int64)
        reach = np.abs(queries.astype(np.float64)) @ lists.most
        single = reach.max(initial=0) < EXACT_SINGLE
        weights = queries.astype(np.float32 if single else np.float64)
        margin = np.where(reach < EXACT, 0.0, 1e-9 * reach)  # beyond EXACT, bounds are only as good as doubles; they give way by that much
        full = self.count[start:stop] >= k
        bar = np.where(full, self.scores[start:stop, -1].astype(np.float64), -np.inf)
        still, depth = np.arange(stop - start), 0
        while len(still):
            depth = min(depth + self.chunk, n)
            at = still if depth == n else still[self._worth(lists, depth, weights[still], bar[still], full[still])]
            if not len(at):
                continue
            high = lists.bounds(depth, True, weights[at])
            if not full[at].all():
                new = ~full[at]
                low = high[new] if depth == n else lists.bounds(depth, False, weights[at[new]])
                bar[at[new]] = np.maximum(bar[at[new]], self._reached(lists, low, self.own[start + at[new]]))
            alive = high >= (bar[at] - 2 * margin[at]).astype(high.dtype)[:, None]
            few = np.count_nonzero(alive, axis=1) <= max(self.resolved, k)
            if depth == n:
                tied = np.flatnonzero(~few & (margin[at] == 0))
                if len(tied):  # of equal scores only the k smallest ids can be wanted
                    last = bar[at[tied]][:, None]
                    equal = (high[tied] == last) & (lists.ids[None, :] != self.own[start + at[tied]][:, None])
                    alive[tied] &= (high[tied] > last) | (equal & (np.cumsum(equal, axis=1) <= k))
                few[:] = True
            if few.any():
                row, place = np.divmod(np.flatnonzero(alive if few.all() else alive[few]), n)
                self._resolve(lists, queries, reach, single, start, at[few][row], place)
                still = np.setdiff1d(still, at[few], assume_unique=True)

    def _worth(self, lists: SortedLists, depth: int, weights: np.ndarray, bar: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Whether bounds are likely to leave few enough vectors; if not, the lists are read on."""
        mean, spread = lists.usual(depth, True, weights)
        expected = bar
        if not full.all():
            low, wide = lists.usual(depth, False, weights)
            expected = np.where(full, bar, low + 2 * SPREAD * wide)
        return mean + SPREAD * spread < expected

    def _reached(self, lists: SortedLists, low: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The k-th of the lower bounds of each query."""
        n = len(lists.ids)
        if n < self.k:
            return np.full(len(own), -np.inf)
        low[lists.ids[None, :] == own[:, None]] = -np.inf
        return np.partition(low, n - self.k, axis=1)[:, n - self.k]

    def _resolve(self, lists: SortedLists, queries: np.ndarray, reach: np.ndarray, single: bool, start: int, row: np.ndarray, place: np.ndarray) -> None:
        """Exact scores of pairs; the best of these and of what the queries had."""
        k, kept = self.k, []
        kind = np.float32 if single else np.float64 if reach.max(initial=0) < EXACT else np.int64
        asked, known = queries.astype(kind), lists.known(kind)
        for first in range(0, len(row), GATHERED):
            r, p = row[first : first + GATHERED], place[first : first + GATHERED]
            score = np.einsum("ij,ij->i", asked[r], known[p]).astype(np.int64)
            ids, at = lists.ids[p], start + r
            last, last_id = self.scores[at, -1], self.ids[at, -1]
            good = (ids != self.own[at]) & ((self.count[at] < k) | (score > last) | ((score == last) & (ids < last_id)))
            kept.append((at[good], score[good], ids[good]))
        if not kept:
            return
        at, score, ids = (np.concatenate(x) for x in zip(*kept, strict=True))
        touched = np.unique(at)
        had, rank = np.nonzero(np.arange(k)[None, :] < self.count[touched][:, None])
        at = np.concatenate([at, touched[had]])
        score = np.concatenate([score, self.scores[touched[had], rank]])
        ids = np.concatenate([ids, self.ids[touched[had], rank]])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < k
        self.scores[at[best], rank[best]] = score[best]
        self.ids[at[best], rank[best]] = ids[best]
        self.count[touched] = np.minimum(k, np.diff(np.append(np.searchsorted(at, touched), len(at))))

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "asked", "vec_id", "score"]
        for start in range(0, len(self.own), self.query_block):
            part = slice(start, start + self.query_block)
            # tells apart queries of one id
            asked = np.array([zlib.crc32(q.tobytes().rstrip(b"\0")) for q in self.queries[part].astype(np.int64)], np.int64)
            own, rank = np.nonzero(np.arange(self.k)[None, :] < self.count[part][:, None])
            columns = [self.own[part][own], asked[own], self.ids[part][own, rank], self.scores[part][own, rank]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def groups(n: int, asked: int) -> tuple[int, int]:
    """Into how many tiles vectors are dealt, and queries into how many parts, so that few rows are sent."""
    pairs = n * asked
    wanted = min(GROUPS, max(pairs // GROUP_PAIRS, min(16, pairs >> 18), 1))
    parts = max(-(-asked // PART), round((2 * asked * wanted / max(1, n)) ** 0.5), 1)
    return min(TILES, -(-wanted // parts)), parts


def exact_top_k(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` highest integer inner products of every query, best first, ties to the smaller id.

    Components become ``floor(scale * x)``. ``queries`` says which rows are queries; candidates are all
    rows but those with the query's id. Rows without an id and vectors that are null or
    hold nulls or non-finite components take no part; a shorter vector's missing
    components count as 0. Rows that repeat are candidates each for itself and one query together.
    Scores have to fit in 64 bits. Returns ``query_id, rank, vec_id, score``; other columns are ignored.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & finite(vector_col)).select(
        F.col(id_col).cast("bigint").alias("id"), scaled(vector_col, scale).alias("v"), queries.alias("is_query")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("id"), packed(batch.column("v")), batch.column("is_query")]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "is_query"])

    rows = stored(rows.mapInArrow(pack, "id bigint, v binary, is_query boolean"), "vectors")
    asked = stored(rows.where("is_query").select("id", "v").distinct(), "asked")
    tiles, parts = groups(rows.count(), asked.count())

    def dealt(df: DataFrame, own: int, others: int, group: Column, is_vector: bool) -> DataFrame:
        """Rows with their group, each repeated for the tiles or parts that it meets."""
        number = F.pmod(F.xxhash64("id", "v"), F.lit(own).cast("bigint")).alias("own")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))).alias("other")
        return df.select("id", "v", number, every).select(group.alias("group"), F.lit(is_vector).alias("is_vector"), "id", "v")

    work = dealt(rows, tiles, parts, F.col("own") * parts + F.col("other"), True).union(
        dealt(asked, parts, tiles, F.col("other") * parts + F.col("own"), False)
    )
    work = work.repartition(tiles * parts, "group").sortWithinPartitions("group", "is_vector")
    block, chunk, resolved, query_block = BLOCK, CHUNK, RESOLVED, QUERY_BLOCK

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, best = None, None
        own: list[tuple[np.ndarray, np.ndarray]] = []  # queries and vectors not yet used, with their ids
        met: list[tuple[np.ndarray, np.ndarray]] = []

        def joined(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            rows, ids = zip(*pieces, strict=True)
            return stacked(list(rows)), np.concatenate(ids)

        def use(least: int) -> None:
            nonlocal best, met
            if own and best is None:
                best = Best(*joined(own), k, chunk, resolved, query_block)
                own.clear()
            if met and best is not None and sum(len(ids) for _, ids in met) >= least:
                rows, ids = joined(met)
                whole = len(ids) if least == 1 else len(ids) // block * block
                for start in range(0, whole, block):
                    best.meet(rows[start : min(start + block, whole)], ids[start : min(start + block, whole)])
                met = [(rows[whole:], ids[whole:])] if whole < len(ids) else []

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal best
            use(1)
            if best is not None:
                yield from best.rows()
            best = None
            met.clear()

        for batch in batches:
            keys, vector = np.asarray(batch.column("group")), batch.column("is_vector").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys * 2 + vector)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if keys[start] != group:
                    yield from ended()
                    group = keys[start]
                piece = batch.slice(start, stop - start)
                rows = unpacked(piece.column("v")), np.asarray(piece.column("id"))
                if not vector[start]:
                    own.append(rows)
                elif own or best is not None:  # vectors of a part without queries are passed over
                    met.append(rows)
                    use(block)
        yield from ended()

    found = work.mapInArrow(search, "query_id bigint, asked bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
