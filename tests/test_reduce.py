"""Bit filters and the key column they serve."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profile
from tallyframe.plans import reduce


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(0, 40_000, 2).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    rows = spark.range(40_000).select("id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    bits = reduce.bits_for(20_000)
    words = reduce.key_bits(keys, "k", bits)
    kept = reduce.keep_possible(rows, "k", words, bits)
    assert kept.columns == ["id", "k"]
    ids = {r["id"] for r in kept.collect()}
    assert set(range(0, 40_000, 2)) <= ids and len(ids) < 22_000
    assert words.count() <= bits // 64
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_sizes_are_bounded(spark):
    assert reduce.bits_for(0) == reduce.LEAST_BITS and reduce.bits_for(10**12) == reduce.MOST_BITS
    assert all(16 * n <= reduce.bits_for(n) < 64 * n for n in (100, 1_000, 10**6))
    with pytest.raises(ValueError):
        reduce.keep_possible(spark.range(1), "id", spark.range(1), reduce.MOST_BITS * 2)


def test_a_full_filter_still_gives_right_results(spark, monkeypatch):
    monkeypatch.setattr(reduce, "LEAST_BITS", 64)
    monkeypatch.setattr(reduce, "MOST_BITS", 64)
    check_key_column(spark)


def test_key_column(spark):
    check_key_column(spark)


def check_key_column(spark):
    rows = [("A.png", "1", None), ("b", "2", "a.jpg"), (None, "3", "zz"), ("c", "1", None), ("A.png", "", None)] * 50
    df = spark.createDataFrame(rows, "name string, num string, `other.col` string")
    files = spark.createDataFrame([("a",), ("b",), ("",), ("a",), (None,)], "stem string")
    got = [tuple(r) for r in profile.infer_key_column(df.toDF("name", "num", "other"), files).collect()]
    assert got == [("name", 0.75, 3, 0.2), ("other", 0.5, 2, 0.6)]
    assert profile.infer_key_column(df.toDF("name", "num", "other"), files.limit(0)).count() == 0
    assert profile.infer_key_column(df.toDF("name", "num", "other").limit(0), files).count() == 0
