"""Skew-safe joins, ranks, pages, quantiles and draws against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import resolve, runs, split, weights
from tallyframe.plans import order, skew
from tallyframe.plans.order import exact_quantiles, running_total, slice_ordered
from tallyframe.plans.skew import hot_keys, key_counts, salted_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, another share is null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(3000).select("id", key.alias("k"))


def test_hot_keys_are_bounded(skewed):
    counts = key_counts(skewed, ["k"])
    assert [tuple(r) for r in hot_keys(counts, ["k"], min_rows=500).collect()] == [("hot", 2)]
    assert hot_keys(counts, ["k"], min_rows=1000) is None
    assert hot_keys(counts, ["k"], min_rows=10).count() > 40
    assert hot_keys(counts, ["k"], min_rows=10, most=5).count() <= 5


@pytest.mark.parametrize("how", ["inner", "left_anti"])
@pytest.mark.parametrize("keys", [200, 10])
def test_hot_keys_in_tasks_of_bounded_size(spark, how, keys):
    """200 hot keys, or one key of nine tenths of the rows: no salt holds much more than was asked for."""
    key = F.col("id") % 200 if keys == 200 else F.when(F.col("id") % 10 > 0, -1).otherwise(F.col("id"))
    left = spark.range(40_000).select("id", key.alias("k"))
    counts = key_counts(left, ["k"])
    hot = hot_keys(counts, ["k"], min_rows=50)
    most = hot.join(counts, "k").select(F.max(F.col("n") / F.col("salts"))).first()[0]
    assert hot.count() == (200 if keys == 200 else 1) and most <= 50
    right = counts.where("k % 2 = 0").select("k")
    joined = salted_join(left, right, ["k"], how, ["id"], min_rows=50)
    assert joined.count() == left.join(right, "k", how).count()


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    right = skewed.where("k is not null and k <> 'k7'").select("k").distinct().withColumn("v", F.length("k"))
    plain = skewed.join(right, "k", how)
    salted = salted_join(skewed, right, ["k"], how, ["id"], min_rows=10)
    assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_salted_join_spreads_the_hot_key(spark, skewed):
    right = skewed.select("k").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(skewed, right, ["k"], "inner", ["id"], min_rows=10)
        sizes = joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8
    assert max(r["count"] for r in sizes) < 1000 / 2


def test_audit_with_a_hot_value(spark, monkeypatch):
    """A third of the rows name one file, a third name none; salting changes nothing."""
    name = F.when(F.col("id") % 3 == 0, "hot.jpg").when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("f"), "id", F.lit(".jpg")))
    rows = spark.range(600).select("id", name.alias("image"))
    paths = spark.range(0, 600, 2).select(F.concat(F.lit("img/f"), "id", F.lit(".jpg")).alias("path"))
    paths = paths.unionByName(spark.createDataFrame([("img/hot.jpg",)], "path string"))

    def run():
        return sorted(map(tuple, resolve.audit(rows, paths, paths, "image", "id", images_dir="img", masks_dir="img").collect()))

    plain = run()
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 20)
    assert run() == plain
    assert sum(r[5] for r in plain) == 200 + 100


def test_ranks_with_hot_and_missing_metrics(spark, monkeypatch):
    metric = F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") / 1000)
    table = spark.range(300).select(F.col("id").alias("experiment_id"), metric.alias("val_f1_macro"))

    def ranks():
        return {r["experiment_id"]: r["rank_f1"] for r in runs.rank_runs(table).collect()}

    plain = ranks()
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 20)
    assert ranks() == plain
    assert plain[0] == 1 and plain[1] is None and plain[299] == 101 and len(plain) == 300


def test_early_stop_over_blocks(spark):
    rows = [("a", i, 0.1 * i) for i in range(1, 30)] + [("b", i, 0.5) for i in range(1, 30)] + [("c", 25, 0.3)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_f1_macro double")
    whole = sorted(map(tuple, runs.early_stop(df).collect()))
    assert sorted(map(tuple, runs.early_stop(df, block=4).collect())) == whole
    # epochs numbered by global steps lie in as few blocks
    sparse = df.withColumn("epoch", F.col("epoch") * 10_000)
    parts = [(r["best_value"], r["stopped_early"]) for r in runs.early_stop(sparse, block=4).orderBy("run").collect()]
    assert parts == [(r["best_value"], r["stopped_early"]) for r in runs.early_stop(df).orderBy("run").collect()]
    with pytest.raises(Exception, match="an epoch is missing"):
        runs.early_stop(df.withColumn("epoch", F.lit(None).cast("bigint")))
    assert [r[:2] for r in whole] == [("a", 29), ("b", 1), ("c", 25)]


def test_eta_over_blocks(spark):
    df = spark.range(1, 50).select((F.col("id") % 2).alias("run"), F.col("id").alias("epoch"), (F.col("id") * 1.5).alias("seconds"))
    whole = {r["epoch"]: r["eta_sec"] for r in runs.eta(df, 60).collect()}
    parts = {r["epoch"]: r["eta_sec"] for r in runs.eta(df, 60, block=5).collect()}
    assert parts == pytest.approx(whole)
    assert whole[3] == pytest.approx(57 * 3.0)


def test_flag_duplicates_with_a_hot_key(skewed):
    flagged = {r["id"]: r["dup"] for r in resolve.flag_duplicates(skewed, "k", ["id"], "dup").collect()}
    assert len(flagged) == 3000 and flagged[0] and flagged[3]


def test_running_total(spark):
    df = spark.range(500).select(((F.col("id") * 7919) % 1009).alias("o"), (F.col("id") % 13).alias("v"))
    rows = sorted(map(tuple, df.collect()))
    totals = np.cumsum([v for _, v in rows])
    got = sorted((r["o"], r["t"]) for r in running_total(df, [F.col("o")], "v", "t").collect())
    assert got == [(o, int(t)) for (o, _), t in zip(rows, totals)]


@pytest.mark.parametrize("offset,limit", [(0, 5), (95, 20), (400, 60), (495, 50), (700, 5)])
def test_deep_pages_equal_shallow_ones(spark, offset, limit):
    df = spark.range(500).select("id", ((F.col("id") * 31) % 7).alias("g"))
    by = [F.col("g").desc(), F.col("id")]
    deep = [r["id"] for r in slice_ordered(df, by, offset, limit, shallow=0, parts=6).collect()]
    everything = sorted(((-(i * 31 % 7), i) for i in range(500)))
    assert deep == [i for _, i in everything[offset : offset + limit]]


@pytest.mark.parametrize("window_rows", [10**6, 0])
def test_exact_quantiles_equal_linear_interpolation(spark, monkeypatch, window_rows):
    monkeypatch.setattr(order, "WINDOW_ROWS", window_rows)
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(40, 3.0), rng.normal(size=57)])
    df = spark.createDataFrame([(float(x), float(i) if i % 4 else None) for i, x in enumerate(values)], "a double, b double")
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"], {"q1": (1, 4), "q2": (1, 2), "q9": (9, 10)}).collect()}
    b = np.array([i for i in range(97) if i % 4])
    for name, q in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
        assert got["a"][name] == pytest.approx(np.quantile(values, q))
        assert got["b"][name] == pytest.approx(np.quantile(b, q))


# Public class sizes of the ten-thousand-image skin lesion set the published split numbers come from.
SIZES = {"mel": 1113, "nv": 6705, "bcc": 514, "akiec": 327, "bkl": 1099, "df": 115, "vasc": 142}


@pytest.fixture(scope="module")
def lesions(spark):
    rows = [(f"{name}_{i}", name) for name, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string")


def test_split_has_the_published_sizes(lesions):
    out = split.stratified_split(lesions, "label", "id")
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 7011, "val": 1502, "test": 1502}
    hits = out.where("split = 'val'").agg(F.avg((F.col("label") == "nv").cast("double"))).first()[0]
    assert round(hits, 4) == 0.6698


def test_split_ignores_partitioning_and_plan(lesions):
    def one(df, **options):
        return {(r["id"], r["split"]) for r in split.stratified_split(df, "label", "id", **options).collect()}

    expected = one(lesions.coalesce(1))
    assert one(lesions.repartition(3)) == expected
    assert one(lesions, max_broadcast=0) == expected


def test_split_moves_no_rows(lesions):
    out = split.stratified_split(lesions.withColumn("payload", F.lit("x")), "label", "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "payload" in line]
    assert not moved


def test_split_of_tiny_and_null_strata(spark):
    df = spark.createDataFrame([(i, None if i < 3 else f"s{i % 40}") for i in range(60)], "id long, s string")
    out = split.stratified_split(df, "s", "id")
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 42, "val": 9, "test": 9}
    assert out.count() == 60


def test_no_group_crosses_splits(spark):
    df = spark.range(2000).select("id", (F.col("id") % 97).alias("g"))
    out = split.group_split(df, "g")
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.select("split").distinct().count() == 3


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(i, 100.0 if i == 7 else (0.0 if i == 3 else 1.0)) for i in range(101)], "id long, w double")
    drawn = weights.weighted_sample(df, "w", "id", 4000)
    counts = {r["id"]: r["count"] for r in drawn.groupBy("id").count().collect()}
    assert sum(counts.values()) == 4000
    assert 3 not in counts
    assert 1850 < counts[7] < 2170  # half of the weight


def test_rare_policy(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else f"r{i}") for i in range(10)], "id long, label string")
    assert split.rare_policy(df, "label", 2, ["id"]).where("label = 'other'").count() == 2
    assert split.rare_policy(df, "label", 2, ["id"], action="drop").count() == 8


def test_small_weights_are_drawn(spark):
    df = spark.range(1000).select("id", F.expr("if(id < 990, 2e-7, 1.98e-5)").alias("w"))
    drawn = weights.weighted_sample(df, "w", "id", 4000)
    light = drawn.where("id < 990").count()
    assert 1800 < light < 2200
    lightest = spark.range(2).select("id", F.expr("if(id = 0, 1e-30, 1.0)").alias("w"))
    assert {r["id"] for r in weights.weighted_sample(lightest, "w", "id", 5).collect()} == {1}
    with pytest.raises(ValueError, match="positive weight"):
        weights.weighted_sample(lightest.withColumn("w", F.lit(0.0)), "w", "id", 5)


def test_rows_too_light_for_the_line_are_drawn_among_themselves(spark, monkeypatch):
    monkeypatch.setattr(weights, "LINE_BITS", 8)
    df = spark.range(2001).select("id", F.expr("if(id = 0, 1000.0, if(id % 2 = 0, 0.2, 1.0))").alias("w"))
    drawn = {r["id"]: r["count"] for r in weights.weighted_sample(df, "w", "id", 20_000).groupBy("id").count().collect()}
    assert sum(drawn.values()) == 20_000 and 8700 < drawn[0] < 9500  # 1000 of 2200
    even = sum(c for i, c in drawn.items() if i and i % 2 == 0)
    assert 1620 < even < 2020 and len(drawn) > 1700  # 200 of 2200, all by the second line


def test_one_heavy_row_leaves_tasks_even(spark, monkeypatch):
    seen = {}
    real = order.carry_last

    def watched(df, by, marker, value, out, parts=None):
        ranged = df.repartitionByRange(16, *by)
        seen["sizes"] = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
        return real(df, by, marker, value, out, parts)

    monkeypatch.setattr(weights, "carry_last", watched)
    df = spark.range(20_000).select("id", F.expr("if(id = 77, 1e9, 1.0)").alias("w"))
    drawn = weights.weighted_sample(df, "w", "id", 20_000)
    assert drawn.where("id = 77").count() > 19_900 and drawn.count() == 20_000
    assert len(seen["sizes"]) == 16 and max(seen["sizes"]) < 2 * sum(seen["sizes"]) / 16


def test_keys_that_repeat_are_one_piece(spark):
    df = spark.createDataFrame([(i % 2, 1.0 if i % 2 else 3.0) for i in range(1000)] + [(5, None), (6, -1.0)], "id int, w double")
    counts = {r["id"]: r["count"] for r in weights.weighted_sample(df, "w", "id", 8000).groupBy("id").count().collect()}
    assert set(counts) == {0, 1} and 5800 < counts[0] < 6200


def test_carry_last(spark):
    rows = [(i, i % 7 == 3, f"v{i}" if i % 14 == 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "at int, mark boolean, v string").repartition(5)
    got = {r["at"]: r["last"] for r in order.carry_last(df, ["at"], "mark", "v", "last", 9).collect()}
    want, last = {}, None
    for i, mark, value in rows:
        last = value if mark else last
        if not mark:
            want[i] = last
    assert got == want
    assert order.carry_last(df.limit(0), ["at"], "mark", "v", "last").count() == 0
