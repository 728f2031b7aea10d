"""CSV records from text splits read in parallel, whatever their quotes.

Whether a line begins inside a quoted field depends on all lines before it. But a line or a
whole split does no more than map "begins outside" and "begins inside" to one of the two. So every split
first tells its map, the maps are put together in file order (one row per split), and then every split
cuts its own lines into records. Only records that cross splits are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Places in a line: where a field begins, in a field without quotes, in a quoted one, after a quote in it, and after
# white space that follows such a quote.
START, PLAIN, QUOTED, CLOSED, SPACED = range(5)
AFTER_QUOTE = {START: QUOTED, PLAIN: PLAIN, QUOTED: CLOSED, CLOSED: QUOTED, SPACED: PLAIN}
SPACE = "".join(map(chr, range(33)))
WHOLE, BEGUN, CONTINUED = range(3)
ROWS = 5000


def stays_open(line: str, sep: str, open_: bool) -> bool:
    """Whether a line ends inside a quoted field, if it begins in one or at a new record.

    A quote opens a field only where the field begins. One that is neither doubled nor followed by the
    delimiter or the line's end makes the rest of its field plain, up to the next delimiter.
    """
    if '"' not in line:
        return open_
    place = QUOTED if open_ else START
    for i, piece in enumerate(line.split('"')):
        if i:
            place = AFTER_QUOTE[place]
        if piece and place != QUOTED:
            _, found, rest = piece.rpartition(sep)
            if found:
                place = PLAIN if rest else START
            elif place in (CLOSED, SPACED) and not piece.strip(SPACE):
                place = SPACED
            else:
                place = PLAIN
    return place == QUOTED


def text_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``file, start, value``: lines in the order of their split; carriage returns stay."""
    value = F.col("value")
    if encoding.upper() not in ("UTF-8", "UTF8"):
        value = F.decode(value.cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("value")
    )


def split_states(lines: DataFrame, sep: str) -> tuple[set[tuple[str, int]], set[str]]:
    """The splits that begin inside a quoted field, and the files whose first line ends with a carriage return.

    The driver sees one row per split, as its scheduler does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, returns = None, (False, True), False
        out = []
        for batch in batches:
            for file, start, line in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "value")], strict=True):
                if (file, start) != key:
                    if key:
                        out.append((*key, *ends, returns))
                    key, ends, returns = (file, start), (False, True), start == 0 and line.endswith("\r")
                if '"' in line:
                    both = stays_open(line, sep, False), stays_open(line, sep, True)
                    ends = tuple(both[e] for e in ends)
        if key:
            out.append((*key, *ends, returns))
        if out:
            names = ["file", "start", "outside", "inside", "returns"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    maps = lines.mapInArrow(run, "file string, start bigint, outside boolean, inside boolean, returns boolean").collect()
    begun, file, open_ = set(), None, False
    for row in sorted(maps, key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, open_ = row["file"], False
        if open_:
            begun.add((row["file"], row["start"]))
        open_ = row["inside"] if open_ else row["outside"]
    return begun, {row["file"] for row in maps if row["returns"]}


def cut_records(lines: DataFrame, sep: str, begun: set[tuple[str, int]], returns: set[str]) -> DataFrame:
    """``file, start, line, record, part, first``: records and parts of those that cross splits, where they are read."""
    sent = lines.sparkSession.sparkContext.broadcast((begun, returns))  # at most the splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, at, line_no, open_, part, headed, strip = None, 0, 0, False, WHOLE, False, False
        held: list[str] = []

        def emit(part: int) -> None:
            nonlocal headed
            text = "\n".join(held)
            if text or part != WHOLE:
                first = not headed and key[1] == 0 and part != CONTINUED
                headed = headed or first
                out.append((*key, at, text, part, first))
            held.clear()

        for batch in batches:
            for file, start, line in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "value")], strict=True):
                if (file, start) != key:
                    if held:
                        emit(CONTINUED if part == CONTINUED else BEGUN)
                    key, line_no, headed = (file, start), 0, False
                    open_, strip = key in sent.value[0], file in sent.value[1]
                    part = CONTINUED if open_ else WHOLE
                if not held:
                    at = line_no
                line = line.removesuffix("\r") if strip else line  # line ends inside quotes too, as when a file is read whole
                held.append(line)
                line_no += 1
                open_ = stays_open(line, sep, open_)
                if not open_:
                    emit(part)
                    part = WHOLE
            if len(out) >= ROWS:
                yield made(out)
                out.clear()
        if held:
            emit(CONTINUED if part == CONTINUED else BEGUN)
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
        parts = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(parts, ["file", "start", "line", "record", "part", "first"])

    return lines.mapInArrow(run, "file string, start bigint, line bigint, record string, part int, first boolean")


def csv_records(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """``file, start, line, record`` of all records but the header of each file; empty lines are no records.

    ``start`` and ``line`` are the split and the line in it where the record begins. A header begins in a file's first split.
    A quote that is never closed takes the rest of its file into one record, as it does when a file is read as a whole (but for
    the file's last line end, which is no part of it here).
    """
    lines = text_lines(spark, path, encoding)
    begun, returns = split_states(lines, sep)
    parts = cut_records(lines, sep, begun, returns)
    columns = ["file", "start", "line", "record"]
    whole = parts.where((F.col("part") == WHOLE) & ~F.col("first")).select(*columns)
    if not begun:
        # the last record of a file may still be open
        return whole.unionByName(parts.where((F.col("part") != WHOLE) & ~F.col("first")).select(*columns))
    crossing = parts.where(F.col("part") != WHOLE)  # two a split at most
    order = Window.partitionBy("file").orderBy("start", "line").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("part") == BEGUN, F.struct("start", "line", "first")), ignorenulls=True).over(order)
    pieces = F.sort_array(F.collect_list(F.struct("start", "line", "record")))
    joined = (
        crossing.withColumn("owner", owner)
        .groupBy("file", "owner")
        .agg(F.array_join(F.transform(pieces, lambda x: x["record"]), "\n").alias("record"))
        .where(~F.col("owner.first"))
    )
    return whole.unionByName(joined.select("file", "owner.start", "owner.line", "record"))
