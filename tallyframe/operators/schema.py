"""The roles of a manifest's columns as one result."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import ALL_IMAGE_EXTS
from tallyframe.operators.profile import (
    KEY_MATCH_GATE,
    MASK_NAME_BONUS,
    TOP_CANDIDATES,
    best_key_column,
    column_facts,
    infer_key_column,
    infer_label_mode,
)

TOP_MATCHES = 20  # fixed value: columns listed by their share of known stems
MASK_WORDS = ("mask", "seg")

SCORES = T.ArrayType(T.StructType([T.StructField("column", T.StringType()), T.StructField("score", T.DoubleType())]))
ROLES = T.StructType(
    [
        T.StructField("image_col", T.StringType()),
        T.StructField("image_col_by_name", T.StringType()),
        T.StructField("image_col_match", T.DoubleType()),
        T.StructField("mask_col", T.StringType()),
        T.StructField("label_cols", T.ArrayType(T.StringType())),
        T.StructField("meta_cols", T.ArrayType(T.StringType())),
        T.StructField("all_columns", T.ArrayType(T.StringType())),
        T.StructField("image_candidates", SCORES),
        T.StructField("mask_candidates", SCORES),
        T.StructField("image_matches", SCORES),
    ]
)


def infer_schema(
    df: DataFrame,
    files: DataFrame | None = None,
    cols: Sequence[str] | None = None,
    exts: Iterable[str] = ALL_IMAGE_EXTS,
    gate: float = KEY_MATCH_GATE,
) -> DataFrame:
    """One row: image, mask, label and meta columns, label mode, and the scores they were chosen by.

    Image and mask column first go by the share of file names in a column (a mask column also by its name); label
    columns are the 0/1 columns besides these, when there are two or more. With ``files`` (a ``stem`` each) the image
    column is the one whose values name most files, and a share below ``gate`` is an error; labels and meta columns
    stay as the names gave them. Two passes over the table, one more with ``files``; the driver sees a row per column.
    """
    cols, exts = list(cols or df.columns), tuple(exts)
    facts = column_facts(df, cols, exts).orderBy("ordinal").collect()  # one row per column
    image_scores = _ranked(facts, False)
    mask_scores = _ranked(facts, True)
    by_name = image_scores[0][0] if image_scores else None
    mask_col = mask_scores[0][0] if mask_scores else None
    binary = [r["column"] for r in facts if r["binary_like"] and r["column"] not in (by_name, mask_col)]
    labels = binary if len(binary) > 1 else []
    meta = [c for c in cols if c not in (*labels, by_name, mask_col)]
    image_col, share, matches = by_name, None, []
    if files is not None:
        scores = infer_key_column(df, files, cols, exts=exts)
        image_col = best_key_column(scores, gate)
        matches = [(r["column"], r["stem_match_ratio"]) for r in scores.limit(TOP_MATCHES).collect()]
        share = matches[0][1]
    roles = (image_col, by_name, share, mask_col, labels, meta, cols, image_scores, mask_scores, matches)
    mode = infer_label_mode(df, labels)
    named = [_literal(v, f.dataType).alias(f.name) for v, f in zip(roles, ROLES, strict=True)]
    return mode.select(*named, "mode", "target_encoding", "ratio_eq_1", "ratio_in_01", F.lit(len(binary)).alias("binary_cols_count"))


def _ranked(facts: Sequence[Row], mask: bool) -> list[tuple[str, float]]:
    """Columns by share of file names, best first; equal ones in the table's order."""
    scored = []
    for row in facts:
        bonus = MASK_NAME_BONUS if mask and any(w in row["column"] for w in MASK_WORDS) else 0.0
        scored.append((row["column"], min(1.0, row["filename_share"] + bonus)))
    return sorted([s for s in scored if s[1] > 0], key=lambda s: -s[1])[:TOP_CANDIDATES]


def _literal(value, kind: T.DataType):
    """Small lists as literals of a stated type, also when they are empty."""
    if isinstance(kind, T.ArrayType):
        items = [F.struct(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in value]
        return F.array(*items).cast(kind)
    return F.lit(value).cast(kind)


def schema_document(schema: DataFrame) -> DataFrame:
    """The schema as one JSON text a row, for a document sink: columns, diagnostics and candidates."""
    part = {
        "columns": ("image_col", "mask_col", "mode", "target_encoding", "label_cols", "meta_cols", "all_columns"),
        "diagnostics": ("binary_cols_count", "ratio_eq_1", "ratio_in_01", "image_col_match"),
        "candidates": ("image_candidates", "mask_candidates", "image_matches"),
    }
    nested = F.struct(*[F.struct(*names).alias(name) for name, names in part.items()])
    return schema.select(F.to_json(nested, {"ignoreNullFields": "false"}).alias("document"))
