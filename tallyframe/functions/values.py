"""Column expressions on cell values, labels and score arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display names of the seven lesion classes.
CLASS_NAMES = {
    "MEL": "Melanoma",
    "NV": "Nevus",
    "BCC": "Basal cell carcinoma",
    "AKIEC": "Actinic keratosis / intraepithelial carcinoma",
    "BKL": "Benign keratosis",
    "DF": "Dermatofibroma",
    "VASC": "Vascular lesion",
}

_INT = r"^-?[0-9]+$"
_FLOAT = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
_WORD = r"(?i)^[+-]?(nan|inf|infinity)$"


def _col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def safe_str(c: str | Column) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def as_double(c: str | Column) -> Column:
    """Number a text cell holds, else null. ``1d`` and the like are not numbers."""
    text = F.trim(_col(c).cast("string"))
    plain = F.when(text.rlike(_FLOAT), F.regexp_replace(text, "_", "").try_cast("double"))
    return F.coalesce(plain, F.when(text.rlike(_WORD), text.try_cast("double")))


def to_number(c: str | Column) -> Column:
    """``struct<kind, as_long, as_double, as_text>``: whole number, else float, else text."""
    text = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    whole = F.when(text.rlike(_INT), text.try_cast("bigint"))
    number = as_double(text)
    kind = (
        F.when(whole.isNotNull(), "int").when(number.isNotNull(), "float").otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        whole.alias("as_long"),
        F.when(whole.isNull(), number).alias("as_double"),
        F.when(whole.isNull() & number.isNull(), text).alias("as_text"),
    )


def coerce_int0(c: str | Column) -> Column:
    """Number truncated to a whole one; text, null and NaN give 0."""
    number = as_double(c)
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(0).cast("bigint"))


def positives(cols: Sequence[str]) -> Column:
    """Names of the columns that equal 1, in column order."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), as_double(F.col(f"`{c}`")).alias("v")) for c in cols]
    )
    return F.transform(F.filter(pairs, lambda p: p["v"] == 1.0), lambda p: p["name"])


def pretty_label(c: str | Column, mapping: Mapping[str, str] = CLASS_NAMES) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(names, _col(c)), _col(c))


def decode_one_hot(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    id_col: str = "id",
    mapping: Mapping[str, str] = CLASS_NAMES,
) -> DataFrame:
    """Adds ``positive_classes``, ``target`` and ``target_pretty``.

    Without ``cols`` every column but the id counts, so a numeric column such
    as an age equal to 1 is a positive too.
    """
    cols = list(cols) if cols is not None else [c for c in df.columns if c != id_col]
    return (
        df.withColumn("positive_classes", positives(cols))
        .withColumn("target", F.array_join("positive_classes", "|"))
        .withColumn("target_pretty", pretty_label("target", mapping))
    )


def issue_codes(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, joined by a pipe."""
    return F.concat_ws("|", *[F.when(broken, F.lit(code)) for broken, code in rules])


def is_close(c: str | Column, target: float = 1.0, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    return F.coalesce(F.abs(_col(c) - F.lit(target)) <= F.lit(atol + rtol * abs(target)), F.lit(False))


def argmax(scores: str | Column) -> Column:
    """Zero-based place of the first largest element."""
    a = _col(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def pick_path(document: str | Column, *paths: str) -> Column:
    """First of several dotted JSON paths with a non-empty value."""
    found = []
    for path in paths:
        value = F.get_json_object(_col(document), "$." + path)
        blank = (F.trim(value) == "") | (F.trim(value) == "[]") | (value == "null")
        found.append(F.when(~blank, value))
    return F.coalesce(*found)


def meta_entries(
    meta: str | Column, hidden: Sequence[str] = ("positive_classes", "target", "target_pretty")
) -> Column:
    """Map without derived keys and without empty values."""
    return F.map_filter(_col(meta), lambda k, v: ~k.isin(*hidden) & v.isNotNull() & (v != ""))


def score_text(c: str | Column) -> Column:
    """Score with two decimals."""
    return F.format_string("%.2f", _col(c).cast("double"))


def date_text(c: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_col(c), pattern)


def risk_level(prob: str | Column, low: float, high: float) -> Column:
    """Three levels by two limits, both given by the caller."""
    p = _col(prob)
    return F.when(p < low, "BAIXO_RISCO").when(p < high, "INCERTO").otherwise("ALTO_RISCO")


def binarize(values: str | Column, threshold: float = 0.0) -> Column:
    return F.transform(_col(values), lambda v: (v > F.lit(threshold)).cast("int"))


def normalize_channels(values: str | Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Interleaved channel values minus the channel mean, over the channel std."""
    k = len(mean)
    means = F.array(*[F.lit(float(m)) for m in mean])
    stds = F.array(*[F.lit(float(s)) for s in std])
    return F.transform(
        _col(values), lambda v, i: (v - F.get(means, i % k)) / F.get(stds, i % k)
    )
