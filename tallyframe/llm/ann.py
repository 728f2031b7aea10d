"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

The neighbour graph starts from random groups and improves by joins: the
neighbours of a node, in both directions, are neighbours of neighbours of each other, so they are
brought together and compared, and every node keeps the best it has met. A query is a node
of the graph; its search starts at its own neighbours and expands the best nodes not yet expanded,
until all of its best are.

Graph and search compare vectors rounded to 8 bits; what is returned is scored on the original ones. Equal
vectors are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import list_slices, map_batches, stored
from tallyframe.llm.topk import finite

NEIGHBOURS = 48  # kept per node
REVERSE = 28  # best of the nodes that have a node as neighbour; the others meet it in later rounds
GROUP = 64  # nodes of a random group
STARTS = 2  # groupings to start from
ROUNDS = 6
EMITTED = 10  # best new neighbours that one meeting gives to a node
BEAM = 192  # best nodes of a search that have to be expanded
EXPANDED = 32  # nodes expanded per step
STEPS = 12
RESCORED = 64  # best of a search that are scored on the original vectors


def codes(vectors: DataFrame) -> DataFrame:
    """``(node, code)``: a vector rounded to 8 bits, and its scale as the last 4 bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, flat = list_slices(batch.column("embedding"))
        values = np.asarray(flat, np.float64)
        out = []
        for i in range(batch.num_rows):
            v = values[at[i] : at[i + 1]]
            scale = np.float32(np.abs(v).max() / 127)
            out.append(np.round(v / (np.abs(v).max() / 127)).astype(np.int8).tobytes() + scale.tobytes())
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "code"])

    return map_batches(vectors, run, "node bigint, code binary")


def decoded(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rounded components, as floats whose sums of products are exact, and scales."""
    raw = array.to_pylist()
    width = max(map(len, raw), default=4)
    data = np.frombuffer(b"".join(r[:-4].ljust(width - 4, b"\0") + r[-4:] for r in raw), np.uint8).reshape(len(raw), width)
    scales = np.ascontiguousarray(data[:, -4:]).view(np.float32)[:, 0].astype(np.float64)
    return np.ascontiguousarray(data[:, :-4]).view(np.int8).astype(np.float32), scales


def meet(groups: DataFrame, emitted: int) -> DataFrame:
    """``(u, w, s)``: for the members of every group, the best others that beat what they have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, flat = list_slices(batch.column("members"))
        nodes = np.asarray(flat.field("m"))
        bars = np.asarray(flat.field("bar"))
        values, scales = decoded(flat.field("code"))
        found = []
        for i in range(batch.num_rows):
            own = slice(at[i], at[i + 1])
            ids, first = np.unique(nodes[own], return_index=True)
            if len(ids) < 2:
                continue
            x, c = values[own][first], scales[own][first]
            s = ((x @ x.T).astype(np.float64) * (c[:, None] * c[None, :])).astype(np.float32)
            np.fill_diagonal(s, -np.inf)
            k = min(emitted, len(ids) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            gain = np.take_along_axis(s, best, 1)
            row, place = np.nonzero(gain > bars[own][first][:, None])
            found.append((ids[row], ids[best[row, place]], gain[row, place]))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "w", "s"])

    return map_batches(groups, run, "u bigint, w bigint, s float")


def neighbour_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """``(u, code, nb)`` with the best neighbours found for every node, best first."""
    n = nodes.count()
    lowest = F.lit(float("-inf")).cast("float")

    def merged(links: DataFrame) -> DataFrame:
        best = F.slice(F.array_distinct(F.sort_array(F.collect_list(F.struct("s", "w")), asc=False)), 1, neighbours)
        lists = links.groupBy("u").agg(best.alias("nb"))
        return stored(nodes.join(lists, nodes["node"] == lists["u"], "left").select(F.col("node").alias("u"), "code", "nb"), "graph")

    starts = []
    for start in range(STARTS):
        group = F.pmod(F.xxhash64("node", F.lit(start)), F.lit(max(1, n // GROUP)).cast("bigint"))
        member = F.struct(F.col("node").alias("m"), lowest.alias("bar"), "code")
        starts.append(meet(nodes.groupBy(group.alias("g")).agg(F.collect_list(member).alias("members")), neighbours))
    graph = merged(starts[0].union(starts[1]))
    for _ in range(rounds):
        links = graph.select("u", F.inline("nb"))
        order = Window.partitionBy("w").orderBy(F.col("s").desc(), "u")
        back = links.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= REVERSE)
        pairs = links.select(F.col("u").alias("v"), F.col("w").alias("m")).union(back.select(F.col("w").alias("v"), F.col("u").alias("m")))
        bar = F.when(F.size("nb") >= neighbours, F.element_at("nb", -1)["s"]).otherwise(lowest)
        known = graph.select(F.col("u").alias("m"), bar.alias("bar"), "code")
        groups = pairs.join(known, "m").groupBy("v").agg(F.collect_list(F.struct("m", "bar", "code")).alias("members"))
        graph = merged(links.unionByName(meet(groups, EMITTED)))
    return graph


STATE = "q bigint, code binary, ids array<bigint>, s array<float>, expanded array<bigint>, seen array<bigint>, front array<bigint>"


def advance(states: DataFrame) -> DataFrame:
    """One step of every search: ``new`` nodes are scored, the best are kept, and the front is chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row] for c in batch.schema.names}
                query, scale = decoded(pa.array([get["code"].as_py()], pa.binary()))
                ids, s = np.array(get["ids"].as_py() or [], np.int64), np.array(get["s"].as_py() or [], np.float32)
                seen = np.array(get["seen"].as_py() or [], np.int64)
                new = get["new"].values
                if new is not None and len(new):
                    w = np.asarray(new.field("w"))
                    values, scales = decoded(new.field("code"))
                    width = min(values.shape[1], query.shape[1])
                    scores = (values[:, :width] @ query[0, :width]).astype(np.float64) * (scales * scale[0])
                    ids, s = np.concatenate([ids, w]), np.concatenate([s, scores.astype(np.float32)])
                    seen = np.concatenate([seen, w])
                order = np.lexsort((ids, -s))[:BEAM]
                ids, s = ids[order], s[order]
                expanded = np.array(get["expanded"].as_py() or [], np.int64)
                front = ids[~np.isin(ids, expanded)][:EXPANDED]
                expanded = np.concatenate([expanded, front])
                rows.append((get["q"].as_py(), get["code"].as_py(), ids, s, expanded, seen, front))
            if rows:
                kinds = [pa.int64(), pa.binary(), *(pa.list_(t) for t in (pa.int64(), pa.float32(), pa.int64(), pa.int64(), pa.int64()))]
                columns = [pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["q", "code", "ids", "s", "expanded", "seen", "front"])

    return states.mapInArrow(run, STATE)


def greedy_search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """``(q, w)``: the best nodes found for every query node ``q``, itself not among them."""
    vectors = graph.select(F.col("u").alias("w"), "code")
    near = graph.select(F.col("u").alias("node"), F.transform("nb", lambda x: x["w"]).alias("near"))
    none = F.array().cast("array<bigint>")
    states = graph.join(queries, graph["u"] == queries["q"]).select(
        "q", "code", none.alias("ids"), F.array().cast("array<float>").alias("s"), none.alias("expanded"), F.array("q").alias("seen"), F.array("q").alias("front")
    )
    for _ in range(STEPS):
        asked = states.select("q", F.explode("front").alias("node")).join(near, "node")
        met = asked.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("met"))
        unseen = states.select("q", "seen").join(met, "q").select("q", F.explode(F.array_except("met", "seen")).alias("w"))
        new = unseen.join(vectors, "w").groupBy("q").agg(F.collect_list(F.struct("w", "code")).alias("new"))
        states = stored(advance(states.drop("front").join(new, "q", "left")), "search")
        if not states.where(F.size("front") > 0).limit(1).count():
            break
    return states.select("q", F.explode(F.slice("ids", 1, RESCORED)).alias("w"))


def inner_product(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    neighbours: int = NEIGHBOURS, rounds: int = ROUNDS,
) -> DataFrame:
    """The ``k`` nearest found of every query, nearest first, ties to the smaller id.

    ``queries`` says which rows are queries; candidates are all rows but those with the query's id.
    Rows without an id and vectors that are null, empty, zero or hold nulls or non-finite components take no part; a
    shorter vector's missing components count as 0. Rows that repeat are
    one candidate and one query. With ``GROUP`` nodes or fewer, all are compared.
    Returns ``query_id, rank, vec_id, score``; other columns are ignored.
    """
    some = F.exists(vector_col, lambda x: x != 0)
    good = vectors.where(F.col(id_col).isNotNull() & finite(vector_col) & some)
    rows = good.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding"), queries.alias("asks"))
    distinct = rows.groupBy("embedding").agg(F.max("asks").alias("asks"))
    named = stored(distinct.withColumn("node", F.xxhash64("embedding")), "nodes")
    graph = neighbour_graph(stored(codes(named.select("node", "embedding")), "codes"), neighbours, rounds)
    found = greedy_search(graph, named.where("asks").select(F.col("node").alias("q")))
    both = found.union(named.where("asks").select(F.col("node").alias("q"), F.col("node").alias("w")))
    vector_of = named.select("node", "embedding")
    scored = (
        both.join(vector_of.select(F.col("node").alias("w"), F.col("embedding").alias("b")), "w")
        .join(vector_of.select(F.col("node").alias("q"), F.col("embedding").alias("a")), "q")
        .select("q", "w", inner_product("a", "b").alias("score"))
    )
    # of equal vectors the k + 1 smallest ids can be wanted
    members = rows.select(F.xxhash64("embedding").alias("w"), "id").distinct()
    by_id = Window.partitionBy("w").orderBy("id")
    members = members.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1).drop("_r")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "w")
    top = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= RESCORED + 1).drop("_r")
    asked = rows.where("asks").select(F.xxhash64("embedding").alias("q"), F.col("id").alias("query_id")).distinct()
    pairs = top.join(members, "w").withColumnRenamed("id", "vec_id")
    first = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    pairs = pairs.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r")
    answers = pairs.join(asked, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
