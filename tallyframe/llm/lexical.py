"""Ranked lexical search: the highest-scoring documents for every item, exactly.

Documents are indexed in blocks, one row per block and term, with the places of the documents that hold
it. Only terms of the items are listed. Corpus figures (documents, terms, documents per term) are sums over
these rows. Then every block answers every item by a hybrid of two ways to read lists:

* term at a time: the short lists of an item are summed into accumulators at once;
* document at a time: the accumulators are one more list with a bound, beside the long ones. Lists
  whose bounds together can't reach the k-th score are only looked into, at documents that
  others have brought up; bounds tell which of these can still qualify.

Blocks keep their k best per item, and the best of all blocks are ranked.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyframe.llm.common import stored, utf8

_TERMS_SQL = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS_SQL} AS term FROM documents) GROUP BY ALL),
  sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
  corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
  lengths AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes, corpus),
  weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
              FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), corpus),
  asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_TERMS_SQL} AS term FROM benchmark) GROUP BY ALL),
  scored AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
             FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""

BLOCK = 32_768  # documents
BLOCK_ENTRIES = 4_000_000  # list entries that close a block before it is full
QUERY_BLOCK = 512  # items
LISTED_TERMS = 500_000, 32 << 20  # item terms, and their bytes, that may be sent to all tasks; more are met by shuffles
SALTS = 64  # tasks for the lists of one term, if they are
WINDOWS = 1024, 16_384  # documents that are looked at before bounds are compared anew: at first, at most

# bytes that are no part of a term become blanks, A to Z become small
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ")


def item_terms(items: DataFrame) -> DataFrame:
    """Terms of items: ``item, part, term, repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (item, part, term, n)
                for item, part, text in zip(*[batch.column(c).to_pylist() for c in ("item", "part", "text")], strict=True)
                for term, n in Counter(terms_of(text)).items()
                if term
            ]
            if rows:
                names = ["item", "part", "term", "repeats"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    schema = "item bigint, part bigint, term binary, repeats bigint"
    return stored(items.select("item", "part", "text").mapInArrow(run, schema), "item-terms")


def index(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None) -> DataFrame:
    """Lists of documents: ``block, term, places, counts`` for every block and wanted term (None: all).

    The row of a block whose term is empty holds its documents instead: their ids in order, and
    ``counts``, their numbers of terms. Places are positions in this order.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("term", T.BinaryType()),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("ids", T.ArrayType(id_type)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spark_block = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes = array("i")
        lists: dict[bytes, tuple[array, array]] = {}
        entries = 0

        def closed() -> pa.RecordBatch:
            nonlocal spark_block, entries
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids), dtype=np.int32)
            names, places, counts = [b""], [np.empty(0, np.int32)], [np.frombuffer(sizes, np.int32)[order]]
            for term, (at, n) in lists.items():
                here = place[np.frombuffer(at, np.int32)]
                by_place = np.argsort(here)
                names.append(term)
                places.append(here[by_place])
                counts.append(np.frombuffer(n, np.int32)[by_place])
            owners = pa.array([[ids[i] for i in order]] + [None] * len(lists), type=pa.list_(id_arrow))
            out = pa.RecordBatch.from_arrays(
                [pa.array([spark_block] * len(names)), pa.array(names, pa.binary()), arrays(places), arrays(counts), owners],
                ["block", "term", "places", "counts", "ids"],
            )
            spark_block += 1
            entries = 0
            ids.clear()
            lists.clear()
            del sizes[:]
            return out

        for batch in batches:
            id_arrow = batch.column("id").type
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                found = [t for t in terms_of(text.as_py()) if t]
                if not found:
                    continue
                at = len(ids)
                ids.append(key.as_py())
                sizes.append(len(found))
                for term, n in Counter(found if wanted is None else filter(wanted.__contains__, found)).items():
                    held = lists.get(term)
                    if held is None:
                        held = lists[term] = (array("i"), array("i"))
                    held[0].append(at)
                    held[1].append(n)
                    entries += 1
                if len(ids) >= BLOCK or entries >= BLOCK_ENTRIES:
                    yield closed()
        if ids:
            yield closed()

    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(run, schema)


def arrays(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the sums of short lists, by place."""
    places = np.concatenate([p for p, _ in lists])
    scores = np.concatenate([s for _, s in lists])
    order = np.argsort(places, kind="stable")
    places, scores = places[order], scores[order]
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return places[first], np.add.reduceat(scores, first)


def best(places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by place."""
    if len(places) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        places, scores = places[kept], scores[kept]
    order = np.lexsort((places, -scores))[:k]
    return places[order], scores[order]


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block of ``size`` documents; ``lists`` hold places in order and scores, none under 0.

    The short lists are those that together are no longer than the longest.
    """
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    if not lists:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    short = int(np.searchsorted(np.cumsum([len(p) for p, _ in lists]), len(lists[-1][0]), "right"))
    floor = 0
    if short:
        merged = accumulated(lists[:short])
        lists = [merged, *lists[short:]]
        if len(merged[0]) >= k:  # what k documents have at least
            floor = int(np.partition(merged[1], len(merged[1]) - k)[len(merged[1]) - k])
    lists.sort(key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(s.max()) for _, s in lists])
    top = np.empty(0, np.int32), np.empty(0, np.int64)
    start, width = 0, WINDOWS[0]
    while start < size:
        end = min(size, start + width)
        width = min(2 * width, WINDOWS[1])
        looked = int(np.searchsorted(bounds, floor, "left"))  # lists that together stay under the k-th score
        if looked == len(lists):
            break
        cuts = [np.searchsorted(p, (start, end)) for p, _ in lists[looked:]]
        raised = [(p[a:b], s[a:b]) for (p, s), (a, b) in zip(lists[looked:], cuts, strict=True) if a < b]
        start = end
        if not raised:
            continue
        places, scores = accumulated(raised)
        for i in range(looked - 1, -1, -1):
            can = scores + bounds[i] >= floor
            places, scores = places[can], scores[can]
            if not len(places):
                break
            other, added = lists[i]
            at = np.minimum(np.searchsorted(other, places), len(other) - 1)
            scores = scores + np.where(other[at] == places, added[at], 0)
        if len(places):
            top = best(np.concatenate([top[0], places]), np.concatenate([top[1], scores]), k)
            if len(top[0]) == k:
                floor = max(floor, int(top[1][-1]))
    found = top[1] > 0
    return top[0][found], top[1][found]


def answers(lists: DataFrame, id_type: T.DataType, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best of every block for every item: ``item, id, score``."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        terms = group.column("term").to_pylist()
        home = terms.index(b"")
        ids = group.column("ids")[home].values
        sizes = np.asarray(group.column("counts")[home].values).astype(np.int64)
        m = 75 + 25 * sizes * n_docs // n_terms
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in range(len(terms)):
            if i == home:
                continue
            places = np.asarray(group.column("places")[i].values)
            tf = np.asarray(group.column("counts")[i].values).astype(np.int64)
            one = group.column("weight")[i].as_py() * (1_000_000_000 * tf // (1000 * tf + 12 * m[places]))
            for x in group.column("items")[i].as_py():
                asked.setdefault(x["item"], []).append((places, one * x["repeats"]))
        found = [(item, *search_block(held, len(ids), k)) for item, held in asked.items()]
        rows = [len(places) for _, places, _ in found]
        if not sum(rows):
            return pa.table([pa.array([], pa.int64()), ids[:0], pa.array([], pa.int64())], ["item", "id", "score"])
        items = pa.array(np.repeat([item for item, *_ in found], rows).astype(np.int64))
        kept = pa.array(np.concatenate([p for _, p, _ in found]))
        return pa.table([items, ids.take(kept), pa.array(np.concatenate([s for *_, s in found]))], ["item", "id", "score"])

    return lists.groupBy("block", "part").applyInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` highest-scoring documents above 0 for every item, all if fewer; equal scores by id, null last.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A to Z lower-cased. A term weighs
    ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; a document scores ``w * (10^9 tf div (1000 tf + 12 m))`` for it,
    with ``m = 75 + 25 n N div L``, and the sum over the item's terms, repeats included.

    A null or empty text has no terms: such documents are not found nor counted, such items
    have no rows. Repeated document rows are documents of their own; an item row that repeats in id and text is
    answered once, one that repeats in id alone for each text, with ranks of their own. Empty tables give no
    rows. Other columns are ignored. Whole texts of any length are read.

    Returns ``item_id, rank, doc_id, score``, the ids under their own names.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = T.StructType(
        [T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type),
         T.StructField("score", T.LongType())]
    )
    asked = items.select(F.col(item_col).alias("item_id"), utf8(item_text).alias("text")).dropDuplicates()
    n_parts = max(1, -(-asked.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)).cast("bigint")
    numbered = stored(asked.withColumn("item", F.monotonically_increasing_id()).withColumn("part", part), "items")
    listed = item_terms(numbered)
    n_listed, n_bytes = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if not n_listed:
        return spark.createDataFrame([], schema)
    few = n_listed <= LISTED_TERMS[0] and n_bytes <= LISTED_TERMS[1]
    wanted = frozenset(bytes(r[0]) for r in listed.select("term").distinct().collect()) if few else None
    lists = stored(index(docs, id_col, text_col, wanted), "lists")
    home = F.col("term") == F.lit(b"")
    words = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    n_docs, n_terms = lists.where(home).agg(F.sum(F.size("counts").cast("bigint")), F.sum(words)).first()
    if not n_docs:
        return spark.createDataFrame([], schema)
    spread = lists.where(~home).groupBy("term").agg(F.sum(F.size("places").cast("bigint")).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    terms = listed.groupBy("term", "part").agg(F.collect_list(F.struct("item", "repeats")).alias("items"))
    terms = terms.join(spread.select("term", weight.alias("weight")), "term")
    none = F.array().cast(terms.schema["items"].dataType)
    homes = spark.range(n_parts).select(F.lit(b"").alias("term"), F.col("id").alias("part"), none.alias("items"), F.lit(0).alias("weight"))
    terms = terms.unionByName(homes)  # the documents of a block go to every block of items
    if few:
        met = lists.join(F.broadcast(terms), "term")
    else:
        salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lists.withColumn("salt", salt).join(salted, ["term", "salt"]).drop("salt")
    found = answers(met, id_type, n_docs, n_terms, k).join(numbered.select("item", "item_id"), "item")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", F.col("id").alias("doc_id"), "score")
