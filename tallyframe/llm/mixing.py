"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within a source the documents are sorted
by key in ranges of equal width: about the square root of its documents as many, so
neither a range nor the list of ranges gets large when a source does. Sizes are
added up per range first, and only the documents of one range are summed in
order. Each source is cut at its exact budget, after as many whole epochs as the
budget holds.

Texts never move: a narrow table of ids, sizes and keys is sorted and summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 42
KEY_BITS = 28  # leading bits of the key that choose the range
BROADCAST_SOURCES = 10_000  # more sources than that are joined, not broadcast


def word_count(text: str | Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def per_source(rows: DataFrame, sources: DataFrame, on: Column) -> DataFrame:
    """``rows`` with their source's row: broadcast when there are few sources, else joined."""
    few = sources.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, on)


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """``number`` and ``target`` of every source from its ``source_size``; one row per source.

    Sources in order of code point, nulls last, weigh ``weights`` in turn. A target
    is ``weight * level``, at most ``epochs`` times the source: sources are capped in
    the order in which a rising level reaches their cap, and the level is
    what the others share. Whole numbers until the last division.
    """
    number = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    caps = (
        sizes.withColumn("number", number).withColumn("_w", weight.cast("bigint")).withColumn("_cap", F.col("source_size") * epochs)
    )
    earlier = Window.orderBy(F.col("_cap") / F.col("_w"), "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    shared = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    wide = "decimal(19,0)"
    capped = F.col("_cap").cast(wide) * F.col("_shared").cast(wide) <= F.col("_rest").cast(wide) * F.col("_w").cast(wide)
    # capped sources come first; the first other one sees what all others share
    first_open = F.max(F.when(~capped, F.struct("_shared", "_rest"))).over(everything)
    levels = caps.withColumn("_rest", rest).withColumn("_shared", shared).withColumn("_open", first_open)
    share = (F.col("_w") * F.col("_open._rest")).cast("double") / F.col("_open._shared").cast("double")
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(share)
    return levels.select(source, "source_size", "number", target.alias("target"))


def placed_documents(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], epochs: int, seed: int
) -> DataFrame:
    """Ids, sizes and keys with their source's plan and the words of the source before each document."""
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("_source"),
            word_count(text_col).alias("size"),
            random_key(seed, id_col).alias("_key"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = source_targets(sizes.drop("_rows"), "_source", weights, epochs)
    plan = stored(
        targets.alias("t")
        .join(sizes.alias("s"), F.col("t._source").eqNullSafe(F.col("s._source")))
        .select(
            F.col("t._source").alias("_of"),
            "t.source_size",
            "number",
            "target",
            F.ceil(F.sqrt("_rows")).cast("bigint").alias("_ranges"),
            F.round("target").cast("bigint").alias("_budget"),
        ),
        "targets",
    )
    leading = F.conv(F.substring("_key", 1, KEY_BITS // 4), 16, 10).cast("bigint")
    placed = per_source(rows, plan, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    placed = placed.withColumn("_range", F.shiftright(leading * F.col("_ranges"), KEY_BITS))
    sums = placed.groupBy("number", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("number").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("number", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("number", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    return summed.join(starts, ["number", "_range"]).withColumn("_start", F.col("_before") + F.col("_inside"))


def epochs_and_part() -> tuple[Column, Column]:
    """Whole epochs of a source, and what its last epoch takes of a document."""
    whole = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    rest = F.col("_budget") - whole * F.col("source_size")
    return whole, F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """How many words the mix takes of every document.

    Returns ``doc_id, size, source_size, target, taken``, one row per row of
    ``docs``; other columns are ignored. A source's budget is its target, rounded; the
    budget's whole epochs take every document as often, the rest goes to the
    documents with the smallest keys, the last of them in part. Null and empty
    texts have size 0 and give nothing; a null source is a source of its own, the
    last one. Rows that repeat are taken each for itself; those with equal id
    and size differ in nothing that is returned. Keys are hashes of ids, so a
    rerun takes the same. An empty table gives no rows.
    """
    placed = placed_documents(docs, id_col, text_col, source_col, weights, epochs, seed)
    whole, part = epochs_and_part()
    taken = (whole * F.col("size") + part).cast("bigint")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = MOST_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The documents of the mix, whole, as often as it takes them; all their columns.

    Rows stay where they are: each compares its key with the last key that its source
    takes. The document at that key stays whole, so a source is over its
    target by less than that document (rows that repeat its id come along).
    Documents without words go.
    """
    placed = placed_documents(docs, id_col, text_col, source_col, weights, epochs, seed)
    whole, part = epochs_and_part()
    cuts = stored(
        placed.groupBy("number", F.col("_source").alias("_of")).agg(
            F.max(whole).cast("int").alias("_whole"), F.max(F.when(part > 0, F.col("_key"))).alias("_last")
        ),
        "cuts",
    )
    again = F.coalesce(random_key(seed, id_col) <= F.col("_last"), F.lit(False)).cast("int")
    cut = per_source(docs.select(F.struct(*docs.columns).alias("_row")), cuts, F.col(f"_row.{source_col}").eqNullSafe(F.col("_of")))
    times = F.when(word_count(F.col(f"_row.{text_col}")) > 0, F.col("_whole") + again).otherwise(F.lit(0))
    key_on_row = cut.withColumn(id_col, F.col(f"_row.{id_col}")).withColumn("_times", times)
    return key_on_row.select(F.explode(F.array_repeat("_row", F.col("_times"))).alias("_row")).select("_row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || doc_id) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS shared
  FROM weighed WINDOW earlier AS (ORDER BY cap / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_ones AS (SELECT max(struct_pack(shared := shared, rest := rest)) AS o FROM levels WHERE cap * shared > rest * w),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap * shared <= rest * w THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * o.rest AS DOUBLE) / CAST(o.shared AS DOUBLE) END AS target
  FROM levels, open_ones),
started AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized),
planned AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.start, CAST(round(t.target) AS BIGINT) AS budget
  FROM started s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + least(greatest(budget % source_size - start, 0), size) END AS BIGINT) AS taken
FROM planned
"""
