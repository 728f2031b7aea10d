"""Target contract: gates, policies, label maps, input rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.values import is_close, issue_codes, pick_path
from tallyframe.operators.resolve import attach_best, image_options, lookup_keys
from tallyframe.plans.order import hash_order, slice_ordered

# Allowed questionnaire answers and limits, sample size and gate of key recovery.
SEX = ("male", "female", "unknown")
LOCALIZATION = (
    "back", "chest", "face", "upper extremity", "lower extremity", "neck",
    "abdomen", "scalp", "ear", "hand", "foot", "unknown",
)
AGE = (0, 120)
IMAGE_SIDE = (256, 2048)
RECOVERY_SAMPLE = 400
RECOVERY_GATE = 0.80
RECOVERY_TOP = 5
RANGE_SLACK = 1e-3
# Objects that may hold a contract's values, and the names a value may have, both in order.
PARENTS = ("target", "target_definition", "target_config", "columns", "schema", "contract", "data")
SYNONYMS = {
    "mode": ("mode", "task_mode"),
    "target_encoding": ("target_encoding", "encoding", "label_encoding"),
    "label_cols": ("label_cols", "labels", "label_columns", "target_cols"),
    "image_col": ("image_col", "image_column", "image", "filename_col", "path_col"),
}
MASK_POLICY = ("mask_policy", "mask.policy")


def label_sum(cols: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(f"`{c}`").cast("double")
    return total


def one_hot_ok(cols: Sequence[str], atol: float = 1e-3) -> Column:
    return is_close(label_sum(cols), 1.0, atol)


def one_hot_integrity(
    df: DataFrame, cols: Sequence[str], split: str = "split", atol: float = 1e-3, policy: str = "abort"
) -> DataFrame:
    """Per split: rows, rows whose labels do not sum to 1, label range, rows the policy keeps."""
    labels = [F.col(f"`{c}`").cast("double") for c in cols]
    low = F.least(*labels) if len(labels) > 1 else labels[0]
    high = F.greatest(*labels) if len(labels) > 1 else labels[0]
    facts = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~one_hot_ok(cols, atol)).alias("n_bad_sum"),
        F.min(low).alias("min_label_val"),
        F.max(high).alias("max_label_val"),
    )
    kept = F.col("n_rows") - F.col("n_bad_sum") if policy == "filter" else F.col("n_rows")
    return facts.select(
        split,
        "n_rows",
        "n_bad_sum",
        (F.col("n_bad_sum") / F.col("n_rows")).alias("bad_sum_ratio"),
        "min_label_val",
        "max_label_val",
        F.lit(atol).alias("atol"),
        F.lit(policy).alias("policy"),
        kept.alias("n_rows_after_policy"),
        ((F.col("min_label_val") >= -RANGE_SLACK) & (F.col("max_label_val") <= 1 + RANGE_SLACK)).alias("in_range"),
    )


def check_integrity(facts: DataFrame, split: str = "split") -> None:
    """Raises when labels leave [0, 1], or when the policy is abort and sums are bad. One row per split."""
    for row in facts.collect():
        if not row["in_range"]:
            raise ValueError(f"{row[split]}: labels outside [0, 1]")
        if row["policy"] == "abort" and row["n_bad_sum"]:
            raise ValueError(f"{row[split]}: {row['n_bad_sum']} rows do not sum to 1")


def apply_policy(df: DataFrame, ok: Column, policy: str = "abort") -> DataFrame:
    """``filter`` keeps good rows; ``abort`` raises with up to five bad ones."""
    good = F.coalesce(ok, F.lit(False))
    if policy == "filter":
        return df.where(good)
    if policy != "abort":
        raise ValueError(f"unknown policy {policy!r}")
    bad = df.where(~good).take(5)
    if bad:
        raise ValueError(f"invalid rows, for example {bad}")
    return df


def out_of_range(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    return df.where(~F.coalesce(F.col(col).between(low, high), F.lit(False)))


def assert_between(df: DataFrame, col: str, low: int, high: int) -> DataFrame:
    bad = out_of_range(df, col, low, high).take(1)
    if bad:
        raise ValueError(f"{col} outside [{low}, {high}], for example {bad[0]}")
    return df


def label_dim(
    documents: DataFrame, label_cols: Sequence[str], col: str = "document", keys: Sequence[str] = ()
) -> DataFrame:
    """``(*keys, idx, label, rule)`` from label maps of any known shape.

    In order: a wrapped list, a wrapped label-to-index map, index keys,
    label-to-index, a bare list of texts, column-to-label (letter case ignored if need
    be), else the label columns themselves. Indexes are JSON numbers; digits in quotes are labels.
    """
    doc = F.col(col)
    as_list, as_map = "array<string>", "map<string,string>"
    options = []

    def from_list(values: Column, rule: str) -> None:
        pairs = F.transform(values, lambda v, i: F.struct(i.cast("int").alias("idx"), v.alias("label")))
        options.append(F.when(F.size(values) > 0, F.struct(pairs.alias("pairs"), F.lit(rule).alias("rule"))))

    def from_map(entries: Column, valid: Column, idx: str, label: str, rule: str) -> None:
        pairs = F.transform(
            F.map_entries(entries),
            lambda e: F.struct(e[idx].try_cast("int").alias("idx"), e[label].alias("label")),
        )
        options.append(F.when(valid, F.struct(F.array_sort(pairs).alias("pairs"), F.lit(rule).alias("rule"))))

    def numbers(values: Column) -> Column:
        return (F.size(values) > 0) & F.forall(values, lambda v: v.rlike("^[0-9]+$"))

    # a text of digits is a label, only a number is an index: types are told by the variant
    variant = F.try_parse_json(doc)

    def all_of(kind: str, path: str, shape: str = "map<string,variant>") -> Column:
        values = F.try_variant_get(variant, path, shape)
        values = F.map_values(values) if shape.startswith("map") else values
        return F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: F.schema_of_variant(v) == kind), F.lit(False))

    # Keys under which label maps are wrapped.
    for key in ("idx_to_label", "index_to_label", "id2label", "classes", "labels"):
        inner = F.get_json_object(doc, f"$.{key}")
        from_list(F.when(inner.startswith("["), F.from_json(inner, as_list)), f"wrapped_list:{key}")
    for key in ("label_to_idx", "label2id", "label2idx"):
        inner = F.get_json_object(doc, f"$.{key}")
        entries = F.when(inner.startswith("{"), F.from_json(inner, as_map))
        from_map(entries, all_of("BIGINT", f"$.{key}"), "value", "key", f"wrapped_dict:{key}")
    whole = F.when(F.trim(doc).startswith("{"), F.from_json(doc, as_map))
    from_map(whole, numbers(F.map_keys(whole)), "key", "value", "digit_key_dict")
    from_map(whole, all_of("BIGINT", "$"), "value", "key", "label_to_idx_dict")
    from_list(F.when(all_of("STRING", "$", "array<variant>"), F.from_json(doc, as_list)), "list")
    lowered = F.transform_keys(whole, lambda k, _: F.lower(k))
    for entries, name, rule in (
        (whole, lambda c: c, "col_to_label_aligned_by_label_cols"),
        (lowered, str.lower, "col_to_label_lower_aligned_by_label_cols"),
    ):
        values = F.array(*[F.try_element_at(entries, F.lit(name(c))) for c in label_cols])
        from_list(F.when(all_of("STRING", "$") & F.forall(values, lambda v: v.isNotNull()), values), rule)
    from_list(F.array(*[F.lit(c) for c in label_cols]), "fallback_use_label_cols")
    chosen = documents.select(*keys, F.coalesce(*options).alias("o"))
    return chosen.select(*keys, F.inline("o.pairs"), F.col("o.rule").alias("rule"))


def label_names(df: DataFrame, dim: DataFrame, n_classes: int, target: str = "target_index") -> DataFrame:
    """Adds ``label``. The dimension is re-keyed on ``0..n_classes-1``, which bounds what is broadcast."""
    slots = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(target))
    named = slots.join(dim.groupBy(F.col("idx").alias(target)).agg(F.min("label").alias("label")), target, "left")
    return df.join(F.broadcast(named), target, "left")


def recover_key_column(
    df: DataFrame,
    files: DataFrame,
    key: str,
    cols: Sequence[str] | None = None,
    sample_n: int = RECOVERY_SAMPLE,
    seed: int = 42,
    images_dir: str = "images",
    root: str = "",
    exts: Sequence[str] | None = None,
    top: int = RECOVERY_TOP,
) -> DataFrame:
    """Text columns by share of sampled values that resolve to a file, best first."""
    text = [c for c, t in df.dtypes if t == "string" and (cols is None or c in cols)]
    sample = slice_ordered(df, [hash_order(seed, key), F.col(key)], 0, sample_n)
    long = sample.select(F.col(key).alias("_row"), *text).unpivot(["_row"], text, "column", "value")
    asked = long.where(F.col("value").isNotNull())
    found = attach_best(
        asked,
        ["value"],
        lambda d: image_options(d, "value", "project", images_dir, root, exts),
        lookup_keys(files, "project", exts),
        "_path",
        ["_row", "column"],
    )
    return (
        found.groupBy("column")
        .agg(F.avg(F.col("_path").isNotNull().cast("double")).alias("ratio_resolved"))
        .where(F.col("ratio_resolved") > 0)
        .orderBy(F.col("ratio_resolved").desc(), "column")
        .limit(top)
    )


def choose_image_column(configured: str | None, columns: Sequence[str], recovered: DataFrame, gate: float = RECOVERY_GATE) -> str:
    """The configured column when the table has it, else the recovered one if it is good enough."""
    if configured in columns:
        return configured
    best = recovered.first()
    if best is None or best["ratio_resolved"] < gate:
        raise ValueError(f"image column {configured!r} is missing and no column resolves well enough: {best}")
    return best["column"]


def contract_fields(document: str | Column = "document") -> dict[str, Column]:
    """Contract values wherever the document keeps them."""

    def anywhere(*keys: str) -> Column:
        return pick_path(document, *[f"{p}{k}" for k in keys for p in ("", "columns.", "target_definition.")])

    return {
        "image_col": anywhere("image_col"),
        "label_cols": anywhere("label_cols"),
        "meta_cols": anywhere("meta_cols"),
        "mode": pick_path(document, "mode", "target_definition.mode"),
        "target_encoding": pick_path(
            document, "target_encoding", "target_definition.target_encoding", "target_definition.source_encoding"
        ),
    }


def places_of(field: str) -> list[str]:
    """JSON paths of a field in the order they are tried: its names at the top, then in each parent."""
    names = SYNONYMS[field]
    return [*names, *[f"{parent}.{name}" for parent in PARENTS for name in names]]


def first_present(parsed: str | Column, paths: Sequence[str]) -> Column:
    """The first value among the paths that is there and not a JSON null, as a variant; empty values count."""
    found = [F.try_variant_get(parsed, f"$.{path}", "variant") for path in paths]
    return F.coalesce(*[F.when(~F.is_variant_null(value), value) for value in found])


def contract_roles(documents: DataFrame, col: str = "document", keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, image_col, label_cols, mode, target_encoding, mask_policy, errors, warnings)`` per contract document.

    A field's names are tried at the top of the document and then in its parents; the first value that is no null is
    taken whatever its type, and the type is then checked: ``label_cols`` has to be a list of two or more, ``image_col``
    a text that is not empty, ``mode`` either absent (``single_label`` is assumed, a warning) or ``single_label``.
    Values of a wrong type are null in their column and named in ``errors``. A document that is no JSON has no values.
    """
    parsed = documents.select(*keys, F.try_parse_json(F.col(col)).alias("_parsed"))
    fields = {field: places_of(field) for field in SYNONYMS} | {"mask_policy": list(MASK_POLICY)}
    found = parsed.select(*keys, *[first_present("_parsed", paths).alias(f"_{f}") for f, paths in fields.items()])

    def text(field: str) -> Column:
        value = F.col(f"_{field}")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    labels = F.when(
        F.schema_of_variant("_label_cols").startswith("ARRAY"), F.try_variant_get("_label_cols", "$", "array<string>")
    )
    typed = found.select(
        *keys, labels.alias("label_cols"), *[text(f).alias(f) for f in fields if f != "label_cols"],
        F.col("_mode").isNotNull().alias("_has_mode"),
    )
    no = F.lit(False)
    errors = issue_codes(
        (F.coalesce(F.size("label_cols"), F.lit(0)) < 2, "LABEL_COLS_INVALID"),
        (F.coalesce("image_col", F.lit("")) == "", "IMAGE_COL_INVALID"),
        (F.col("_has_mode") & ~F.coalesce(F.col("mode") == "single_label", no), "MODE_UNSUPPORTED"),
    )
    warnings = issue_codes(
        (~F.col("_has_mode"), "MODE_ASSUMED"),
        (F.col("target_encoding").isNull(), "ENCODING_MISSING"),
        (F.col("target_encoding") != "one_hot_multiclass", "ENCODING_UNEXPECTED"),
    )
    mode = F.when(F.col("_has_mode"), F.col("mode")).otherwise("single_label")
    return typed.select(
        *keys, "image_col", "label_cols", mode.alias("mode"), "target_encoding", "mask_policy",
        errors.alias("errors"), warnings.alias("warnings"),
    )


def effective_contract(
    contracts: DataFrame,
    image_col: str | Column,
    source: str,
    policy: str = "abort",
    atol: float = 1e-3,
    sample_n: int = RECOVERY_SAMPLE,
    seed: int = 42,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Contract rows with the column that is really used and the gates that apply."""
    fields = contract_fields()
    effective = image_col if isinstance(image_col, Column) else F.lit(image_col)
    return contracts.select(
        *keys,
        F.lit(source).alias("source"),
        fields["image_col"].alias("image_col_from_config"),
        F.coalesce(effective, fields["image_col"]).alias("image_col_effective"),
        fields["label_cols"].alias("label_cols"),
        F.coalesce(fields["meta_cols"], F.lit("[]")).alias("meta_cols"),
        fields["mode"].alias("mode"),
        fields["target_encoding"].alias("target_encoding"),
        F.lit(policy).alias("policy"),
        F.lit(atol).alias("atol"),
        F.lit(sample_n).alias("sample_n"),
        F.lit(seed).alias("seed"),
    )


def prefer_effective(original: DataFrame, effective: DataFrame, key: str) -> DataFrame:
    """Documents of ``effective`` where it has the key, else those of ``original``. Keys are unique."""
    kept = effective.select(key, F.col("document").alias("_effective"))
    return original.join(kept, key, "left").select(
        key,
        F.coalesce("_effective", "document").alias("document"),
        F.when(F.col("_effective").isNotNull(), "effective").otherwise("original").alias("used"),
    )


def validate(df: DataFrame, rules: Sequence[tuple[Column, str]], out: str = "violations") -> DataFrame:
    """Adds the codes of the rules each row breaks and whether it is valid."""
    return df.withColumn(out, issue_codes(*rules)).withColumn("valid", F.col(out) == "")


def enum_rule(col: str, allowed: Sequence[str]) -> Column:
    """Broken when the value is missing or not allowed."""
    return ~F.coalesce(F.col(col).isin(*allowed), F.lit(False))


def range_rule(col: str, low: float, high: float, required: bool = False) -> Column:
    inside = F.col(col).between(low, high)
    return ~F.coalesce(inside, F.lit(not required))


def required_rule(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col).cast("string")), F.lit("")) == ""


def validate_inputs(df: DataFrame) -> DataFrame:
    """The questionnaire's rules."""
    return validate(
        df,
        [
            (enum_rule("sex", SEX), "SEX"),
            (enum_rule("localization", LOCALIZATION), "LOCALIZATION"),
            (range_rule("age", *AGE), "AGE"),
            (range_rule("height", *IMAGE_SIDE, required=True), "IMAGE_HEIGHT"),
            (range_rule("width", *IMAGE_SIDE, required=True), "IMAGE_WIDTH"),
        ],
    )


