"""Deep pages by order keys against a sort of everything."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import pages
from tallyframe.plans.pages import page_by_keys


def rows(spark, n=6000):
    i = F.col("id")
    return spark.range(n).select(
        "id",
        F.when(i % 11 != 0, (i * 31) % 7).alias("g"),
        F.when(i % 5 != 0, F.concat(F.lit("k"), (i * 7919 % 97).cast("string"))).alias("name"),
        F.when(i % 9 == 0, F.lit(float("nan"))).otherwise((i * 13 % 101).cast("double")).alias("x"),
        F.timestamp_seconds(1_700_000_000 + i * 37 % 501).alias("at"),
        (F.timestamp_seconds(1_700_000_000 + i * 37 % 501)).cast("timestamp_ntz").alias("local"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i * 3 % 50).cast("int")).alias("day"),
        (i * 17 % 1000).cast("decimal(9,2)").alias("price"),
    )


ORDERS = [
    [("g", False), ("id", True)],
    [("g", True), ("name", False), ("id", False)],
    [("x", True), ("id", True)],
    [("x", False), ("at", True), ("id", False)],
    [("local", False), ("id", True)],
    [("day", True), ("price", False), ("id", True)],
]


@pytest.mark.parametrize("keys", ORDERS, ids=lambda k: "-".join(c for c, _ in k))
@pytest.mark.parametrize("offset,limit", [(60, 20), (3000, 45), (5990, 50)])
def test_equals_a_full_sort(spark, monkeypatch, keys, offset, limit):
    monkeypatch.setattr(pages, "slice_ordered", None)  # no table is written
    df = rows(spark)
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]
    want = [r["id"] for r in df.orderBy(*order).collect()][offset : offset + limit]
    got = page_by_keys(df, keys, offset, limit, shallow=30, sample=900)
    assert got.columns == df.columns
    assert [r["id"] for r in got.collect()] == want


def test_pages_cover_tied_rows_once(spark):
    df = spark.range(4000).select("id", F.lit(1).alias("same"))
    found = [page_by_keys(df, [("same", True)], o, 1000, shallow=1, sample=500) for o in range(0, 4000, 1000)]
    ids = [r["id"] for page in found for r in page.collect()]
    assert sorted(ids) == list(range(4000))


def test_equal_rows_and_ends(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("v"))
    got = page_by_keys(df, [("v", True)], 1490, 20, shallow=5, sample=200)
    assert [r["v"] for r in got.collect()] == [0] * 10 + [1] * 10
    assert page_by_keys(df, [("v", True)], 3000, 5, shallow=5, sample=200).count() == 0
    assert page_by_keys(df, [("v", True)], 10, 0, shallow=5).count() == 0
    assert page_by_keys(df.limit(0), [("v", True)], 10, 5, shallow=5).count() == 0
    with pytest.raises(ValueError):
        page_by_keys(df, [("v", True)], -1, 5)
    with pytest.raises(TypeError):
        page_by_keys(df.select(F.array("v").alias("a")), [("a", True)], 10, 5, shallow=1)


def test_only_keys_are_read_until_the_last_pass(spark, tmp_path):
    rows(spark).withColumn("wide", F.repeat(F.lit("w"), 1000)).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    page = page_by_keys(stored, [("price", False), ("id", True)], 4000, 10, shallow=30, sample=900)
    pushed = page._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(price" in pushed and "LessThanOrEqual(price" in pushed
    assert page.count() == 10


def test_times_do_not_pass_through_a_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Lisbon")
    try:
        at = datetime.datetime(2023, 10, 29, 0, 0, tzinfo=datetime.timezone.utc)
        # the night in which an hour comes twice
        df = spark.range(2000).select("id", F.timestamp_seconds(F.lit(int(at.timestamp())) + F.col("id") * 5).alias("at"))
        got = page_by_keys(df, [("at", True)], 900, 10, shallow=5, sample=900)
        assert [r["id"] for r in got.collect()] == list(range(900, 910))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
