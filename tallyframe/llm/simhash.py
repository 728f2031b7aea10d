"""Near duplicates by SimHash: tiled exact comparison of fingerprints.

Fingerprints meet in buckets of keys that two near ones are bound to share; a
bucket is cut into tiles, and a tile compares all its fingerprints with numpy
exclusive-or and bit counts. The tiles of a large bucket are bands of population counts:
pairs of tiles whose counts differ beyond the radius are skipped, the others are
dealt out as pairs, so no bucket is one task's work.

A tile gives a forest over its near fingerprints, not all its pairs: as much as components need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import list_slices, map_batches, stored, utf8, with_field
from tallyframe.llm.graph import components

SEED = 42
TILE = 1024
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width: two fingerprints within 2 bits agree on one of 3 blocks
RUN_BASE = 0xD6E8FEB86659FD93  # odd
BIT_ROWS = 1 << 16  # shingles whose bits are counted at a time


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    tokens = text.lower().split()
    if len(tokens) <= words:
        whole = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)] if tokens else []
        return np.array(whole, np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False))
    return np.fromiter((digest(r, SEED) for r in runs), np.uint64, len(tokens) - words + 1)


def run_hashes(text: bytes, words: int) -> np.ndarray:
    """As ``shingle_hashes``, but made of the words' hashes: each word is hashed once, whatever number of runs it is in."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    each = mixed(np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)), 0)
    words = min(words, len(tokens))
    runs = np.zeros(len(tokens) - words + 1, np.uint64)
    for i in range(words):
        runs = runs * np.uint64(RUN_BASE) + each[i : i + len(runs)]
    return mixed(runs, words)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        part = np.ascontiguousarray(hashes[at : at + BIT_ROWS])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other hashes of the same things (the finalizer of splitmix64)."""
    x = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, print)`` per row of ``docs``; a text without words has print 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [simhash(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
        prints = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], ["doc_id", "print"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")), run, with_field(docs, id_col, "print bigint"))


def block_keys(bits: Column) -> Column:
    """The blocks of a fingerprint, each with its number."""
    keys = []
    for number, (first, width) in enumerate(BLOCKS):
        value = F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(value + F.lit(number << 32))
    return F.array(*keys)


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Differing bits of all pairs; fingerprints of several lanes count together."""
    return sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(np.uint8) for x, y in zip(a, b, strict=True))


def forest(distance: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The shortest links of near rows that join every component (Prim's spanning forest)."""
    distance = distance.copy()
    np.fill_diagonal(distance, 255)
    rows = np.flatnonzero((distance <= radius).any(1))
    if not len(rows):
        return []
    distance = distance[np.ix_(rows, rows)]
    links = []
    nearest, by = np.full(len(rows), 255, np.uint8), np.zeros(len(rows), np.int64)
    apart = np.ones(len(rows), bool)
    for _ in range(len(rows)):
        gap = np.where(apart, nearest, 255)
        i = int(gap.argmin())
        if gap[i] <= radius:
            links.append((int(rows[i]), int(rows[by[i]])))
        else:  # another component begins
            i = int(apart.argmax())
        apart[i] = False
        closer = distance[i] < nearest
        nearest[closer], by[closer] = distance[i][closer], i
    return links


def similar_pairs(near: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which near rows have sets of that Jaccard similarity; rows that others already join are not compared."""
    distance = np.full(near.shape, 255, np.uint8)
    root = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    x, y = np.nonzero(np.triu(near, 1))
    possible = np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y])
    for i, j in zip(x[possible].tolist(), y[possible].tolist(), strict=True):
        if root[i] != root[j]:
            both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if both >= least * (size[i] + size[j] - both):
                distance[i, j] = distance[j, i] = 0
                root[root == root[j]] = root[i]
    return distance


def tile_links(
    prints: DataFrame, lanes: Sequence[str], radius: int, group: str | None = None, sets: DataFrame | None = None, least: float = 0.0
) -> DataFrame:
    """Links ``(a, b)`` between nodes whose fingerprints differ in ``radius`` bits or fewer.

    ``prints`` has ``node``, the columns ``lanes`` and the array ``keys``: only nodes
    that share a key are compared. Without ``group`` a tile's links are a forest over its near
    nodes; with it each node has a link to its nearest in another group; with ``sets`` (``node`` and the sorted
    ``set`` of its 32-bit hashes) the links are a forest over near nodes of different groups whose sets have a
    similarity of ``least``, and no pair leaves the tile that is not.
    """
    also = [group] if group else []
    keyed = prints.select(F.explode("keys").alias("key"), "node", *lanes, *also)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cuts = F.ceil(F.col("_n") / TILE)
    ones = sum((F.bit_count(c) for c in lanes), F.lit(0))
    placed = keyed.join(counts, "key").select(
        "key",
        (F.col("_n") > TILE).alias("large"),
        F.when(F.col("_n") > TILE, F.floor(ones / (radius + 1))).otherwise(0).cast("int").alias("band"),
        F.when(F.col("_n") > TILE, F.pmod(F.xxhash64("node"), cuts)).otherwise(0).cast("bigint").alias("salt"),
        "node",
        *lanes,
        *also,
    )
    if sets is not None:
        placed, also = placed.join(sets, "node"), [*also, "set"]
    tiles = stored(
        placed.groupBy("key", "large", "band", "salt")
        .agg(F.collect_list(F.struct("node", *lanes, *also)).alias("rows"))
        .withColumn("tile", F.xxhash64("key", "band", "salt")),
        "tiles",
    )
    places = tiles.where("large").select("key", "tile", "band", "salt")
    other = places.select("key", *[F.col(c).alias(f"{c}_b") for c in ("tile", "band", "salt")])
    later = (F.col("band_b") == F.col("band") + 1) | ((F.col("band_b") == F.col("band")) & (F.col("salt_b") > F.col("salt")))
    pairs = places.join(other, "key").where(later).select("tile", "tile_b")
    rows = tiles.where("large").select("tile", "rows")
    both = pairs.join(rows, "tile").join(rows.select(F.col("tile").alias("tile_b"), F.col("rows").alias("rows_b")), "tile_b")
    work = tiles.select("rows", F.slice("rows", 1, 0).alias("rows_b")).union(both.select("rows", "rows_b"))

    with_sets = sets is not None

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        (at_a, flat_a), (at_b, flat_b) = list_slices(batch.column("rows")), list_slices(batch.column("rows_b"))
        nodes_a, nodes_b = np.asarray(flat_a.field("node")), np.asarray(flat_b.field("node"))
        lanes_a = [np.asarray(flat_a.field(c)).view(np.uint64) for c in lanes]
        lanes_b = [np.asarray(flat_b.field(c)).view(np.uint64) for c in lanes]
        groups = [np.asarray(x.field(group)) for x in (flat_a, flat_b)] if group else None
        found = []
        for i in range(batch.num_rows):
            sa, sb = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
            nodes = np.concatenate([nodes_a[sa], nodes_b[sb]])
            n = sa.stop - sa.start
            if len(nodes) > n:  # two tiles: each has seen to its own pairs
                distance = np.full((len(nodes), len(nodes)), 255, np.uint8)
                distance[:n, n:] = distances([x[sa] for x in lanes_a], [x[sb] for x in lanes_b])
                distance[n:, :n] = distance[:n, n:].T
            else:
                distance = distances([x[sa] for x in lanes_a], [x[sa] for x in lanes_a])
            if groups:
                own = np.concatenate([groups[0][sa], groups[1][sb]])
                apart = np.where(own[:, None] != own[None, :], distance, 255)
                if not with_sets:
                    best = apart.argmin(1)
                    x = np.flatnonzero(apart[np.arange(len(nodes)), best] <= radius)
                    found.append(np.stack([nodes[x], nodes[best[x]]], 1))
                    continue
                parts = [flat_a.field("set")[sa.start : sa.stop], flat_b.field("set")[sb.start : sb.stop]]
                known = [np.frombuffer(v.as_buffer(), np.uint32) for part in parts for v in part]
                links = forest(similar_pairs(apart <= radius, known, least), 0)
                if links:
                    found.append(nodes[np.array(links)])
            else:
                links = forest(distance, radius)
                if links:
                    found.append(nodes[np.array(links)])
        if not found:
            return None
        links = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(links.min(1)), pa.array(links.max(1))], ["a", "b"])

    return map_batches(work, compare, "a bigint, b bigint").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Documents whose fingerprints link at 2 or fewer differing bits, in components.

    Returns ``doc_id, print, component_id`` per row of ``docs``: the fingerprint of the
    ``words``-word shingles and the smallest id that links reach, the document's own included.
    Null and wordless texts have fingerprint 0 and link like any other. Rows that repeat keep their rows; a null id is never a
    component's smallest unless it has no other. Other columns are ignored. An empty table gives no rows.

    Copies meet once: what is compared are the distinct fingerprints. Two of them within 2 bits agree
    on one of three blocks of bits, which are the buckets, so no pair is lost.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "prints")
    distinct = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    nodes = distinct.select(F.col("print").alias("node"), F.col("print").alias("w0"), block_keys(F.col("print")).alias("keys"))
    roots = components(tile_links(nodes, ["w0"], 2))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", "print", "component_id")


# -- near copies by similarity -----------------------------------------------------------------------------

SIMILARITY = 0.8
COPY_WORDS = 5
COPY_BITS = 38  # of 128: fingerprints of texts at the similarity differ in 20 on average, of unrelated ones in 64
PAIRED_MINIMA = 12  # each shared by texts at the similarity with chance 0.64: all missed once in 200,000


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Two lanes of fingerprint and bucket keys of every text; ``node`` stands for the text."""
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node")
    rows = docs.select(F.col(id_col).alias("doc_id"), node, utf8(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lanes, keys = [], []
        for text in batch.column("text").to_pylist():
            hashes = np.unique(shingle_hashes(text, words))
            lanes.append((simhash(hashes), simhash(mixed(hashes, 1))))
            if not len(hashes):
                keys.append(None)
                continue
            minima = np.array([mixed(hashes, lane).min() for lane in range(2, 2 + 2 * PAIRED_MINIMA)])
            number = np.arange(PAIRED_MINIMA, dtype=np.uint64)
            keys.append(mixed(mixed(minima[0::2], 1) ^ (minima[1::2] + number), 1).view(np.int64))
        w = np.array(lanes, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("node"),
                pa.array(np.ascontiguousarray(w[:, 0])),
                pa.array(np.ascontiguousarray(w[:, 1])),
                pa.array([[] if k is None else k for k in keys], pa.list_(pa.int64())),
            ],
            ["doc_id", "node", "w0", "w1", "keys"],
        )

    return map_batches(rows, run, with_field(docs, id_col, "node bigint, w0 bigint, w1 bigint, keys array<bigint>"))


def similar(pairs: DataFrame, texts: DataFrame, reps: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs of nodes whose shingle sets have a Jaccard similarity of ``least`` or more, from their texts."""

    def with_text(rows: DataFrame, side: str) -> DataFrame:
        rep = reps.select(F.col("node").alias(side), F.col("rep").alias("_id"))
        own = texts.select(F.col("node").alias(side), F.col("doc_id").alias("_own"), F.col("text").alias(f"text_{side}"))
        named = rows.join(rep, side)
        return named.join(own, (named[side] == own[side]) & named["_id"].eqNullSafe(own["_own"])).drop(own[side]).drop("_id", "_own")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            p, q = (np.unique(shingle_hashes(t, words)) for t in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= least * (len(p) + len(q) - both))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(with_text(with_text(pairs, "a"), "b").select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")


def node_sets(nodes: DataFrame, texts: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """``(node, set)``: the sorted 32-bit hashes of a node's shingles."""
    own = reps.join(nodes, "node").select(F.col("node").alias("_node"), "rep")
    rows = texts.join(own, (texts["node"] == own["_node"]) & texts["doc_id"].eqNullSafe(own["rep"])).select("node", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.unique(shingle_hashes(t, words).astype(np.uint32)).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], ["node", "set"])

    return map_batches(rows, run, "node bigint, set binary").dropDuplicates(["node"])


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = COPY_WORDS, least: float = SIMILARITY
) -> DataFrame:
    """One document of every group of exact and near copies: the one with the smallest id. All its columns stay.

    Near copies have sets of ``words``-word shingles with a Jaccard similarity of ``least`` or more; groups are the
    components of that relation. Candidates come from the tiles of 128-bit fingerprints; their texts decide.
    First a forest over the candidates is verified, so that a large group is joined by as many links as it has
    texts; then all candidate pairs that are still in different groups, within their tiles. Null texts count as empty; all texts that are equal are copies.
    """
    made = stored(sketches(docs, id_col, text_col, words), "sketches")
    rows = made.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    reps = stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "n")).alias("r")).select("node", F.col("r.doc_id").alias("rep"), "r.n"), "reps")
    nodes = made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("w0", "w1", "keys")])
    texts = docs.select(
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(id_col).alias("doc_id"), utf8(text_col).alias("text")
    )
    likely = stored(tile_links(nodes, ["w0", "w1"], COPY_BITS), "likely")
    links = stored(similar(likely, texts, reps, words, least).distinct(), "near")
    roots = components(links)
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = stored(tile_links(grouped, ["w0", "w1"], COPY_BITS, "root"), "apart")
    if apart.limit(1).count():
        # texts near another group's: all their pairs are compared, in their tiles
        unsure = apart.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = stored(node_sets(unsure, texts, reps, words), "sets")
        again = grouped.join(sets.select("node"), "node", "left_semi")
        more = stored(tile_links(again, ["w0", "w1"], COPY_BITS, "root", sets, least), "more")
        links = links.union(similar(more, texts, reps, words, least))
        roots = components(links)
    rooted = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = stored(rooted.groupBy("root").agg(F.min(F.struct("rep", "node", "n")).alias("r")).select("r.*"), "kept")
    whole = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_node"), F.struct(*docs.columns).alias("_row"))
    same = (F.col("_node") == F.col("node")) & F.col(f"_row.{id_col}").eqNullSafe(F.col("rep"))

    def winners(chosen: DataFrame) -> DataFrame:
        return whole.join(chosen, same).select("_node", "_row")

    result = winners(kept)
    if kept.where("n > 1").limit(1).count():  # rows that repeat with their id: one of each
        result = winners(kept.where("n = 1")).union(winners(kept.where("n > 1")).dropDuplicates(["_node"]))
    return result.select("_row.*")
