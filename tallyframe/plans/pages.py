"""Pages at any depth that move only the page.

The rows of a deep page are found by their order keys alone. A sample of the
keys proposes two splitters around the page, one pass counts the rows before
and between them, and this goes on between the splitters until few rows are
left. No row is shuffled or written meanwhile: each pass is an aggregate over
a scan of the key columns, and the last one reads the other columns of the rows
between the last two splitters.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.order import SHALLOW_ROWS, slice_ordered

SAMPLED_KEYS = 10_000
SLACK = 4  # standard deviations of a rank in the sample

Key = tuple[Column | str, bool]  # what to order by, and whether it ascends
Bound = Sequence[Any]


def page_by_keys(
    df: DataFrame,
    keys: Sequence[Key],
    offset: int,
    limit: int,
    shallow: int = SHALLOW_ROWS,
    sample: int = SAMPLED_KEYS,
) -> DataFrame:
    """Rows ``offset .. offset + limit`` in the order of ``keys``; nulls first ascending, last descending.

    Keys are numbers, texts, bytes, booleans, dates or times. Where many rows agree on all of them, a hash of the whole
    row goes on, so pages do not overlap; rows equal in everything are laid out by :func:`slice_ordered`.
    The driver holds about ``sample`` keys at a time.
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    keys = [(F.col(c) if isinstance(c, str) else c, up) for c, up in keys]
    if offset + limit <= shallow:
        return df.orderBy(*_sort([(c, up) for c, up in keys])).offset(offset).limit(limit)
    if not limit:
        return df.limit(0)
    enough = max(shallow, 2 * limit)
    low: Bound | None = None
    high: Bound | None = None
    before, inside = 0, df.count()
    hashed = False
    while inside > enough:
        if before + inside <= offset:
            return df.limit(0)
        names = [f"_key{i}" for i in range(len(keys))]
        ups = [up for _, up in keys]
        within = df.select(*[_comparable(df, c).alias(n) for n, (c, _) in zip(names, keys, strict=True)])
        within = within.where(_between(names, ups, low, high))
        proposed = _splitters(within, names, ups, offset - before, limit, inside, sample)
        first, last = proposed[0] or low, proposed[1] or high
        earlier = _side(names, ups, first, after=False) if proposed[0] else F.lit(False)
        later = _side(names, ups, last, after=True) if proposed[1] else F.lit(False)
        counted = within.agg(F.count_if(earlier).alias("earlier"), F.count_if(later).alias("later")).first()
        # a splitter on the wrong side of the page leaves the old bound as it is
        start, end = before, before + inside
        if proposed[0] and before + counted["earlier"] <= offset:
            low, start = first, before + counted["earlier"]
        if proposed[1] and before + inside - counted["later"] >= min(offset + limit, before + inside):
            high, end = last, before + inside - counted["later"]
        shrunk = end - start <= inside * 0.75
        before, inside = start, end - start
        if not shrunk and inside > enough:
            if hashed:
                break
            # ties: the whole row's hash goes on; bounds so far hold for any value of it
            keys, hashed = [*keys, (F.xxhash64(*_hashable(df)), True)], True
            low = None if low is None else [*low, _ANY]
            high = None if high is None else [*high, _ANY]
    columns = df.columns
    names = [f"_key{i}" for i in range(len(keys))]
    ups = [up for _, up in keys]
    keyed = df.select("*", *[_comparable(df, c).alias(n) for n, (c, _) in zip(names, keys, strict=True)])
    left = keyed.where(_between(names, ups, low, high))
    order = _sort([(F.col(n), up) for n, up in zip(names, ups, strict=True)])
    if inside > enough:
        return slice_ordered(left, order, offset - before, limit, shallow=0).select(*columns)
    return left.orderBy(*order).offset(offset - before).limit(limit).select(*columns)


class _Any:
    """In a bound: every value of this key is at the bound."""


_ANY = _Any()


def _sort(keys: Sequence[tuple[Column, bool]]) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in keys]


def _hashable(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c, t in df.dtypes if "map<" not in t and t != "variant"]


def _comparable(df: DataFrame, key: Column) -> Column:
    """Times as microseconds, so that bounds do not pass through a time zone."""
    kind = df.select(key.alias("k")).dtypes[0][1]
    if kind == "timestamp":
        return F.unix_micros(key)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), key)
    if kind.startswith(("array", "struct", "map", "variant", "interval")):
        raise TypeError(f"rows cannot be paged by a key of type {kind}")
    return key


def _side(names: Sequence[str], ups: Sequence[bool], bound: Bound, after: bool) -> Column:
    """Whether a row comes strictly after (or before) the bound."""
    found = F.lit(False)
    for name, up, value in reversed(list(zip(names, ups, bound, strict=True))):
        if value is _ANY:
            continue
        key, past = F.col(name), None
        if up == after:  # past the bound in the direction in which values grow and nulls end
            past = key.isNotNull() if value is None else key > F.lit(value)
        elif value is not None:
            past = key.isNull() | (key < F.lit(value))
        past = F.lit(False) if past is None else F.coalesce(past, F.lit(False))
        same = key.isNull() if value is None else key.eqNullSafe(F.lit(value))
        found = past | (same & found)
    return found


def _between(names: Sequence[str], ups: Sequence[bool], low: Bound | None, high: Bound | None) -> Column:
    kept = F.lit(True)
    if low is not None:
        kept = kept & _reach(names[0], ups[0], low[0], after=True) & ~_side(names, ups, low, after=False)
    if high is not None:
        kept = kept & _reach(names[0], ups[0], high[0], after=False) & ~_side(names, ups, high, after=True)
    return kept


def _reach(name: str, up: bool, value: Any, after: bool) -> Column:
    """The first key at the bound or past it: follows from the whole test, in a form that scans can skip files by.

    Not for floating point numbers, as the statistics of files may leave out NaN.
    """
    key = F.col(name)
    if isinstance(value, float):
        return F.lit(True)
    if up == after:
        return F.lit(True) if value is None else key >= F.lit(value)
    return key.isNull() if value is None else key.isNull() | (key <= F.lit(value))


def _splitters(
    within: DataFrame, names: Sequence[str], ups: Sequence[bool], offset: int, limit: int, rows: int, sample: int
) -> tuple[Bound | None, Bound | None]:
    """Keys of a sample that probably lie before the page's first row and after its last."""
    drawn = within if rows <= sample else within.sample(fraction=sample / rows, seed=rows)
    order = _sort([(F.col(n), up) for n, up in zip(names, ups, strict=True)])
    # ``sample`` keys, whatever the number of rows
    found = [tuple(r) for r in drawn.orderBy(*order).collect()]
    if not found:
        return None, None
    if rows <= sample:  # these are all keys
        return found[offset], found[min(offset + limit, rows) - 1]
    share = len(found) / rows
    slack = int(SLACK * len(found) ** 0.5 / 2) + 1
    first, last = int(offset * share) - slack, int((offset + limit) * share) + slack
    return (found[first] if first > 0 else None), (found[last] if last < len(found) else None)
