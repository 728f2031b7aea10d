"""The prefix trie of conversations, built by bursting and sweeping containers.

A conversation becomes a string of turn ids of fixed width; equal conversations are one string with a
count. A container holds the strings that share a head, all their first turns. A container of more
strings than one task should sweep bursts: the turns that all of its strings share
become nodes at once, and the next turn id deals the strings to new containers. The others are sorted
by Spark and swept in one pass: a node is done when the sorted strings leave it.

What lies below a burst head is known only when its containers are done, so the sums of
subtrees go up from container to container, latest bursts first; one row per burst container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import stored
from tallyframe.plans.skew import salted_join

STRINGS = 8192  # different conversations of a container that one pass sweeps
ID = 32  # hexadecimal digits of a turn's hash
WIDTH = ID + 8  # and of its words
SHARED = 3  # most turns that a conversation takes from the one it follows
PIECE = 50_000  # ids that are joined before they are hashed
ROWS = 20_000  # nodes written at a time
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f".{{{WIDTH}}}"), F.lit(0))


def head(text: Column, turns: Column) -> Column:
    return F.substr(text, F.lit(1), turns * WIDTH)


def turn_strings(turns: DataFrame) -> DataFrame:
    """Every conversation as ``conv_id, seq``, its turns in order; texts stay where they are read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.concat(
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, ID),
        F.lpad(F.lower(F.hex(words)), WIDTH - ID, "0"),
    )
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn.alias("id"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["id"]), "").alias("seq"))


def rebuild(own: DataFrame, group: int) -> DataFrame:
    """The first turns of a conversation are those of the one it follows: ``conv_id, path, seq``."""
    base = F.col("conv_id") - F.col("conv_id") % group
    taken = F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)
    first = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.substring("seq", 1, SHARED * WIDTH).alias("lead")
    )
    rows = own.select("conv_id", "seq", base.alias("base"), taken.cast("int").alias("taken")).join(first, "base", "left")
    lead = head(F.coalesce("lead", F.lit("")), F.col("taken"))
    rest = F.substr(F.col("seq"), F.col("taken") * WIDTH + 1)
    return rows.select("conv_id", F.concat(lead, rest).alias("seq")).withColumn("path", F.sha2("seq", 256))


def end_digests(rows: DataFrame) -> DataFrame:
    """``path, ends``: the hash of the ids of all conversations of a path, in order.

    Ids are joined in pieces where ranges of them lie, so that one path may hold most conversations: only its
    pieces meet, and are hashed as they come.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids = None, []
        out: list[tuple] = []
        for batch in batches:
            for key, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != path or len(ids) >= PIECE:
                    if ids:
                        out.append((path, ids[0], ",".join(map(str, ids))))
                    path, ids = key, []
                ids.append(conv)
            if len(out) >= ROWS:
                yield columns(out, ["path", "first", "ids"])
                out = []
        if ids:
            out.append((path, ids[0], ",".join(map(str, ids))))
        if out:
            yield columns(out, ["path", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == path:
                    digest.update(b"," + ids.encode())
                else:
                    if digest:
                        out.append((path, digest.hexdigest()))
                    path, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield columns(out, ["path", "ends"])
        if digest:
            yield columns([(path, digest.hexdigest())], ["path", "ends"])

    ranged = rows.select("path", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("path", "conv_id")
    pieces = ranged.mapInArrow(joined, "path string, first bigint, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "first").mapInArrow(hashed, "path string, ends string")


def columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


class Open:
    """A node while strings below it still come; ``kids`` are done and wait for its smallest member."""

    __slots__ = ("conv", "depth", "ends", "kids", "leaves", "n", "saved", "words")

    def __init__(self, depth: int, words: int) -> None:
        self.depth, self.words = depth, words
        self.conv: int | None = None
        self.ends, self.n, self.leaves, self.saved = NO_ENDS, 0, 0, 0
        self.kids: list[tuple] = []

    def member(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.n += n

    def done(self) -> tuple:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.words
        return (self.conv, self.depth, self.n, len(self.kids), self.leaves, self.saved, self.ends)


def sweep(rows: DataFrame) -> DataFrame:
    """Nodes of all containers: sorted strings are followed by the nodes that are open between them.

    ``up`` is the container above, for the topmost node of each container; null for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[Open] = []
        container, top, up, parent, last = None, 0, None, None, ""

        def close(depth: int) -> None:
            """Ends all nodes deeper than ``depth``; their children are written, as their parent is now known."""
            while stack and stack[-1].depth > depth:
                node = stack.pop()
                row = node.done()
                out.extend((*kid[:2], node.conv, *kid[2:], None) for kid in node.kids)
                if stack:
                    above = stack[-1]
                    above.kids.append(row)
                    above.member(node.conv, node.n)
                    above.leaves += node.leaves
                    above.saved += node.saved
                else:
                    out.append((*row[:2], parent, *row[2:], up))

        names = ["container", "up", "p", "parent", "seq", "n", "conv", "ends"]
        for batch in batches:
            for key, above, p, over, seq, n, conv, ends in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                depth = len(seq) // WIDTH
                if key != container:
                    close(-1)
                    container, top, up, parent = key, p, above, over
                    common = top - 1
                else:
                    common, most = top, min(len(seq), len(last)) // WIDTH
                    while common < most and seq[common * WIDTH : (common + 1) * WIDTH] == last[common * WIDTH : (common + 1) * WIDTH]:
                        common += 1
                    close(common)
                for d in range(common + 1, depth + 1):
                    stack.append(Open(d, int(seq[d * WIDTH - WIDTH + ID : d * WIDTH], 16)))
                stack[-1].member(conv, n)
                stack[-1].ends = ends
                last = seq
            if len(out) >= ROWS:
                yield nodes(out)
                out.clear()
        close(-1)
        if out:
            yield nodes(out)

    def nodes(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        parts = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(parts, [*NODE_COLUMNS, "up"])

    ordered = rows.select("container", "up", "p", "parent", "seq", "n", "conv", "ends")
    ordered = ordered.repartition("container").sortWithinPartitions("container", "seq")
    return ordered.mapInArrow(run, f"{NODE}, up string")


def burst(strings: DataFrame, most: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Strings in containers of at most ``most``, and the containers that burst, round by round; None without strings.

    The first round bursts the root whatever its size. Every other round goes at least one turn further down.
    """
    rows = strings.select(
        F.lit("").alias("container"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("p"),
        F.lit(None).cast("bigint").alias("parent"), "seq", "n", "conv", "ends",
    )
    parked: DataFrame | None = None
    heads: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("container", "up", "p", "parent").agg(
            F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
            F.min("seq").alias("lo"), F.min_by("ends", "seq").alias("lo_ends"), F.max("seq").alias("hi"),
        )
        same = F.zip_with(blocks(F.col("lo")), blocks(F.col("hi")), lambda a, b: F.coalesce(a == b, F.lit(False)))
        differ = F.array_position(same, False)
        shared = F.when(differ == 0, F.size(blocks(F.col("lo")))).otherwise(differ - 1).cast("int")
        large = sizes.where((F.col("size") > most) | F.lit(not heads)).withColumn("q", shared)
        large = stored(large.drop("hi"), "burst")
        if large.isEmpty():
            return (rows if parked is None else parked.unionByName(rows)) if heads else None, heads
        tops = large.select("container", "q", F.col("conv").alias("top"))
        if heads:
            met = salted_join(rows, tops, ["container"], "left", ["seq"])
        else:
            root = tops.first()
            met = rows.withColumn("q", F.lit(root["q"])).withColumn("top", F.lit(root["top"]).cast("bigint"))
        met = stored(met, "containers")
        heads.append(large)
        stay = met.where(F.col("q").isNull()).drop("q", "top")
        parked = stay if parked is None else parked.unionByName(stay)
        # a string that ends with the head itself is the least of its container and has no next turn
        rows = met.where(F.length("seq") > F.col("q") * WIDTH).select(
            F.sha2(head(F.col("seq"), F.col("q") + 1), 256).alias("container"), F.col("container").alias("up"),
            (F.col("q") + 1).alias("p"), F.col("top").alias("parent"), "seq", "n", "conv", "ends",
        )


def burst_nodes(heads: list[DataFrame], swept: DataFrame) -> list[DataFrame]:
    """Nodes of the containers that burst; the sums below them go up, latest round first."""
    done = swept.where(F.col("up").isNotNull()).select("up", "n_leaves", "saved_tokens")
    out: list[DataFrame] = []
    for large in reversed(heads):
        below = done.groupBy(F.col("up").alias("container")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        depths = F.explode(F.sequence(F.col("p"), F.col("q")))
        turns = large.join(below, "container", "left").withColumn("depth", depths)
        words = F.when(F.col("depth") > 0, F.conv(F.substr("lo", F.col("depth") * WIDTH - WIDTH + ID + 1, F.lit(WIDTH - ID)), 16, 10).cast("bigint"))
        spent = (F.col("n") - 1) * F.coalesce(words, F.lit(0))
        further = Window.partitionBy("container").orderBy(F.desc("depth"))  # the head's own turns, one conversation long
        last = F.col("depth") == F.col("q")
        ended = last & (F.length("lo") == F.col("q") * WIDTH)
        nodes = turns.select(
            F.col("conv").alias("conv_id"),
            F.col("depth").cast("bigint").alias("depth"),
            F.when(F.col("depth") > F.col("p"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("bigint").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + F.sum(spent).over(further)).cast("bigint").alias("saved_tokens"),
            F.when(ended, F.col("lo_ends")).otherwise(NO_ENDS).alias("ends_sha256"),
            F.when(F.col("depth") == F.col("p"), F.col("up")).alias("up"),
        )
        if large is not heads[0]:
            nodes = stored(nodes, "heads")
            # containers of an earlier round may lie anywhere above, so all sums go on together
            done = done.unionByName(nodes.where(F.col("up").isNotNull()).select("up", "n_leaves", "saved_tokens"))
        out.append(nodes.select(*NODE_COLUMNS))
    return out


def build_trie(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """One row per different sequence of first turns, the root included; ``conversations`` have ``conv_id, path, seq``."""
    strings = conversations.groupBy("path", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    strings = stored(strings.join(end_digests(conversations), "path").select("seq", "n", "conv", "ends"), "strings")
    rows, heads = burst(strings, STRINGS if most is None else most)
    if rows is None:
        return conversations.sparkSession.createDataFrame([], NODE)
    swept = stored(sweep(rows), "swept")
    out = swept.select(*NODE_COLUMNS)
    for nodes in burst_nodes(heads, swept):
        out = out.unionByName(nodes)
    return out


def prefix_trie(turns: DataFrame, group: int = 20, most: int | None = None) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    Turns go by ``turn``, null first, equal numbers by a hash of role and text; repeated rows are turns of
    their own. A null role or text is an empty one. Rows without a ``conv_id`` belong to no
    conversation. A conversation starts with as many turns of the first of its ``group`` as
    its id says and goes on with its own. An empty table gives no rows; extra columns are ignored. Two turns are the same
    if 128 bits of a hash and their words are. A conversation is held as one string of 40 characters a
    turn, so its length, not that of its texts, is bounded by a task's memory.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.
    """
    rebuilt = stored(rebuild(turn_strings(turns), group), "rebuilt")
    return build_trie(rebuilt, most)


def _nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def _crc_step(x: str) -> str:
    table = [_nibble(n) for n in range(16)]
    return f"xor(({x}) >> 4, ({table})[((({x}) & 15) + 1)])"


SQL = f"""WITH turns AS (SELECT conv_id, turn, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS id,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
              FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(words ORDER BY turn NULLS FIRST, id) AS words,
            xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
              lambda c, b: {_crc_step(_crc_step("xor(c, b)"))}), 4294967295) % 4 AS h
          FROM turns GROUP BY conv_id),
  rebuilt AS (SELECT o.conv_id, list_concat(coalesce(b.ids[1:o.h], []), o.ids[o.h + 1:]) AS ids,
                list_concat(coalesce(b.words[1:o.h], []), o.words[o.h + 1:]) AS words
              FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
  prefixes AS (SELECT conv_id, depth, array_to_string(ids[1:depth], '') AS path, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words,
                 depth = len(ids) AS ended
               FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS depth FROM rebuilt)),
  nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
            FROM prefixes GROUP BY path, depth),
  kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
  trees AS (SELECT left(path, CAST(64 * above AS BIGINT)) AS path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
            FROM (SELECT n.path, n.saved, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, n.depth + 1)) AS above
                  FROM nodes n LEFT JOIN kids k ON n.path = k.path) GROUP BY ALL)
  SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
  FROM nodes n JOIN trees t ON n.path = t.path LEFT JOIN kids k ON n.path = k.path
  LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, CAST(64 * (n.depth - 1) AS BIGINT))"""
