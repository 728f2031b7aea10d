"""Behaviours that are easy to lose: ids, duplicates, inference rules, gates, metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import names, scores, values
from tallyframe.operators import contract, items, metrics, profile, resolve, runs
from tallyframe.sources import history
from tallyframe.sources.files import describe_paths


def column(spark, cells, expr, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_ids_keep_case_and_drop_any_suffix(spark):
    cells = ["images/IMG_1.JPG", "a\\b\\X.y.z", ".x", "a.", "", None, "  q.png ", "plain", "dir/"]
    assert column(spark, cells, names.normalize_id("c")) == ["IMG_1", "X.y", ".x", "a.", "", "", "q", "plain", ""]


def test_stems_are_lower_case_and_drop_known_suffixes_only(spark):
    cells = ["images/IMG_1.JPG", "X.y.z", ".jpg", "a.TIFF", None, "IMG_7", "a/b.png/"]
    assert column(spark, cells, names.norm_stem("c")) == ["img_1", "x.y.z", ".jpg", "a", "", "img_7", "b"]


def test_extension_sets_differ_by_step(spark):
    assert column(spark, ["a.tif"], names.looks_like_filename("c")) == [True]
    assert column(spark, ["a.tif"], names.looks_like_filename("c", names.PROJECT_IMAGE_EXTS)) == [False]
    assert column(spark, ["a.bmp"], names.looks_like_filename("c", names.PAGE_IMAGE_EXTS)) == [False]


def test_column_names():
    assert [names.normalize_name(n) for n in (" Age  (years)", "__A-b__c", "ÀX")] == ["age_years", "ab_c", "x"]


def test_aliases_and_candidates(spark):
    got = column(spark, ["IMG_1_segmentation", "MASK-IMG_2", "mask_x_seg", " a mask"], names.mask_aliases("c"))
    assert [sorted(g) for g in got] == [
        ["IMG_1", "IMG_1_segmentation"],
        ["IMG_2", "MASK-IMG_2"],
        ["mask_x", "mask_x_seg", "x_seg"],
        ["a", "a mask"],
    ]
    first = column(spark, ["A_seg"], names.mask_candidates("c"))[0]
    assert [c["key"] for c in first if c["prio"] == 0] == ["a_seg"]
    assert [c["key"] for c in first if c["prio"] >= 100] == ["a"]


def test_upload_suffix(spark):
    df = spark.createDataFrame([("a.PNG", ""), ("a.gif", "image/PNG"), ("a", "x"), (None, None)], "n string, t string")
    assert [r[0] for r in df.select(names.upload_ext("n", "t")).collect()] == [".png", ".png", ".jpg", ".jpg"]


def test_numbers(spark):
    cells = ["12", "-3", "1.5", "1e3", "abc", "", "+5", "nan", "1_0", "1d", ".5", "--2", " 7 "]
    got = column(spark, cells, values.to_number("c"))
    kinds = ["int", "int", "float", "float", "text", "text", "float", "float", "float", "text", "float", "text", "int"]
    assert [g["kind"] for g in got] == kinds
    assert got[8]["as_double"] == 10.0 and got[12]["as_long"] == 7
    assert column(spark, ["1.9", "-1.9", "x", None, "nan"], values.coerce_int0("c")) == [1, -1, 0, 0, 0]


def test_any_metadata_equal_to_one_is_positive(spark):
    df = spark.createDataFrame([("a", "1", "0", "1"), ("b", "0", "0", "30"), ("c", "0", "1.0", "4")], "id string, MEL string, NV string, age string")
    rows = {r["id"]: r for r in values.decode_one_hot(df).collect()}
    assert rows["a"]["target"] == "MEL|age" and rows["a"]["target_pretty"] == "MEL|age"
    assert rows["b"]["target"] == "" and rows["b"]["positive_classes"] == []
    assert rows["c"]["target_pretty"] == "Nevus"
    only = {r["id"]: r["target"] for r in values.decode_one_hot(df, ["MEL", "NV"]).collect()}
    assert only == {"a": "MEL", "b": "", "c": "NV"}


def test_first_maximum_wins(spark):
    assert column(spark, [[1.0, 3.0, 3.0], [5.0, 5.0]], values.argmax("c"), "array<double>") == [1, 0]


def test_tolerances(spark):
    assert column(spark, [1.001005, 1.00102, 0.5, None], values.is_close("c"), "double") == [True, False, False, False]


def test_duplicate_files(spark):
    paths = ["d/IMG_1.jpg", "d/IMG_1.PNG", "d/b.png"]
    found = describe_paths(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r["id"]: r["image_filename"] for r in resolve.images_by_id(found).collect()} == {"IMG_1": "IMG_1.PNG", "b": "b.png"}
    masks = describe_paths(spark.createDataFrame([("m/x_seg.png",), ("m/x.png",), ("m/X_mask.png",)], "path string"))
    by_alias = {r["id"]: r["mask_filename"] for r in resolve.masks_by_alias(masks).collect()}
    assert by_alias["x"] == "x.png" and by_alias["X"] == "X_mask.png"


def test_masks_are_counted_as_files(spark):
    images = describe_paths(spark.createDataFrame([("i/a.png",)], "path string"))
    masks = describe_paths(spark.createDataFrame([("m/a_seg.png",), ("m/mask_b.png",)], "path string"))
    row = items.summary(images, masks, spark.range(4), ["id", "NV"]).first()
    assert (row["num_images"], row["num_masks"], row["csv_rows"], row["columns"]) == (1, 2, 4, ["id", "NV"])


def test_smallest_path_wins_in_the_audit(spark):
    rows = spark.createDataFrame([(0, "A.jpg"), (1, "zz/B"), (2, ""), (3, None), (4, "none.png")], "i int, image string")
    images = spark.createDataFrame([("img/sub/a.png",), ("img/other/A.jpg",), ("img/b.jpg",)], "path string")
    masks = spark.createDataFrame([("msk/a_lesion_mask.png",), ("msk/z.png",)], "path string")
    got = {r["row_idx"]: r for r in resolve.audit(rows, images, masks, "image", "i", images_dir="img", masks_dir="msk").collect()}
    assert got[0]["resolved_image_rel"] == "img/other/A.jpg"
    assert got[0]["resolved_mask_rel"] == "msk/a_lesion_mask.png" and got[0]["issues"] == ""
    assert got[1]["image_exists"] and got[1]["issues"] == "MASK_NOT_FOUND_ON_DISK"
    for i in (2, 3):
        assert got[i]["issues"] == "CSV_IMAGE_VALUE_EMPTY|IMAGE_NOT_FOUND_ON_DISK|MASK_NOT_FOUND_ON_DISK"
    assert got[4]["issues"].startswith("IMAGE_NOT_FOUND")


def test_audit_prefers_the_named_mask(spark):
    rows = spark.createDataFrame([(0, "a.jpg", "other.png"), (1, "a.jpg", "gone.png"), (2, "a.jpg", "word")], "i int, image string, mask string")
    images = spark.createDataFrame([("img/a.jpg",)], "path string")
    masks = spark.createDataFrame([("msk/a.png",), ("msk/other.png",)], "path string")
    got = resolve.audit(rows, images, masks, "image", "i", "mask", images_dir="img", masks_dir="msk").collect()
    assert {r["row_idx"]: r["resolved_mask_rel"] for r in got} == {0: "msk/other.png", 1: "msk/a.png", 2: "msk/a.png"}


def test_audit_without_masks(spark):
    rows = spark.createDataFrame([(0, "a.jpg")], "i int, image string")
    images = spark.createDataFrame([("img/a.jpg",)], "path string")
    row = resolve.audit(rows, images, None, "image", "i", images_dir="img").first()
    assert row["issues"] == "" and row["mask_exists"] is False


def test_binary_like_ignores_text(spark):
    df = spark.createDataFrame([("x", "1", "2", None), ("1", "0", "1", None)], "a string, b string, c string, d string")
    assert {r["column"]: r["binary_like"] for r in profile.binary_columns(df).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_label_mode_thresholds(spark):
    def mode(ones, zeros, twos):
        rows = [(1, 0)] * ones + [(0, 0)] * zeros + [(1, 1)] * twos
        return profile.infer_label_mode(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).first()["mode"]

    assert mode(90, 10, 0) == "single_label"
    assert mode(89, 11, 0) == "multi_label"
    assert mode(97, 0, 3) == "multi_label"
    assert profile.infer_label_mode(spark.createDataFrame([(1,)], "a int"), ["a"]).first()["mode"] == "unknown"


def test_duplicates_count_rows_and_groups(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("",), ("",), ("b",)], "k string")
    row = profile.duplicates(df, "k").first()
    assert (row["rows_in_groups"], row["groups"]) == (5, 2)


def test_key_column_gate(spark):
    df = spark.createDataFrame([("a.jpg", "x"), ("b.jpg", "y"), (None, "a")], "name string, other string")
    stems = spark.createDataFrame([("a",), ("b",)], "stem string")
    scores_ = profile.infer_key_column(df, stems)
    rows = {r["column"]: r for r in scores_.collect()}
    assert rows["name"]["stem_match_ratio"] == 1.0 and rows["name"]["nunique"] == 2
    assert rows["name"]["missing_ratio"] == pytest.approx(1 / 3)
    assert profile.best_key_column(scores_) == "name"
    with pytest.raises(RuntimeError):
        profile.best_key_column(scores_.where("column = 'other'"), gate=0.5)


def test_one_hot_gates(spark):
    df = spark.createDataFrame([("train", 1.0, 0.0), ("train", 0.5, 0.0), ("val", 0.0, 1.0)], "split string, a double, b double")
    facts = contract.one_hot_integrity(df, ["a", "b"])
    rows = {r["split"]: r for r in facts.collect()}
    assert rows["train"]["n_bad_sum"] == 1 and rows["val"]["n_bad_sum"] == 0
    with pytest.raises(ValueError, match="train"):
        contract.check_integrity(facts)
    with pytest.raises(ValueError):
        contract.apply_policy(df, contract.one_hot_ok(["a", "b"]))
    assert contract.apply_policy(df, contract.one_hot_ok(["a", "b"]), "filter").count() == 2
    wide = spark.createDataFrame([("train", 1.5, -0.5)], "split string, a double, b double")
    with pytest.raises(ValueError, match="outside"):
        contract.check_integrity(contract.one_hot_integrity(wide, ["a", "b"], policy="filter"))


def test_target_range_gate(spark):
    df = spark.createDataFrame([(0,), (6,)], "t int")
    assert contract.assert_between(df, "t", 0, 6) is df
    with pytest.raises(ValueError):
        contract.assert_between(df, "t", 0, 5)


LABEL_MAPS = {
    '{"index_to_label": ["a", "b"], "label_to_index": {"a": 0, "b": 1}}': ("wrapped_list:index_to_label", ["a", "b"]),
    '{"label2id": {"b": 0, "a": 1}}': ("wrapped_dict:label2id", ["b", "a"]),
    '{"0": "x", "1": "y"}': ("digit_key_dict", ["x", "y"]),
    '{"q": 1, "p": 0}': ("label_to_idx_dict", ["p", "q"]),
    '["m", "n"]': ("list", ["m", "n"]),
    '{"c1": "First", "c2": "Second"}': ("col_to_label_aligned_by_label_cols", ["First", "Second"]),
    '{"C1": "First", "C2": "Second"}': ("col_to_label_lower_aligned_by_label_cols", ["First", "Second"]),
    '{"z": "First"}': ("fallback_use_label_cols", ["c1", "c2"]),
}


@pytest.mark.parametrize("text", list(LABEL_MAPS))
def test_label_map_shapes(spark, text):
    doc = spark.createDataFrame([(text,)], "document string")
    rows = contract.label_dim(doc, ["c1", "c2"]).orderBy("idx").collect()
    rule, labels = LABEL_MAPS[text]
    assert [r["label"] for r in rows] == labels
    assert {r["rule"] for r in rows} == {rule}


def test_image_column_choice(spark):
    recovered = spark.createDataFrame([("stem", 0.9)], "column string, ratio_resolved double")
    assert contract.choose_image_column("image", ["image", "stem"], recovered) == "image"
    assert contract.choose_image_column("image", ["stem"], recovered) == "stem"
    with pytest.raises(ValueError):
        contract.choose_image_column("image", ["stem"], recovered, gate=0.95)


def test_effective_contract_is_preferred(spark):
    a = spark.createDataFrame([(1, "orig1"), (2, "orig2")], "k int, document string")
    b = spark.createDataFrame([(2, "eff2")], "k int, document string")
    assert {r["k"]: (r["document"], r["used"]) for r in contract.prefer_effective(a, b, "k").collect()} == {
        1: ("orig1", "original"),
        2: ("eff2", "effective"),
    }


def test_questionnaire_rules(spark):
    rows = [("male", "back", 40, 300, 300), ("x", "back", None, 300, 100), (None, "knee", 121, 2048, None)]
    df = spark.createDataFrame(rows, "sex string, localization string, age int, height int, width int")
    got = [r["violations"] for r in contract.validate_inputs(df).collect()]
    assert got == ["", "SEX|IMAGE_WIDTH", "SEX|LOCALIZATION|AGE|IMAGE_WIDTH"]


def test_macro_f1_counts_labels_seen_on_either_side(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "y_true int, y_pred int")
    row = metrics.evaluate(df).first()
    assert row["accuracy"] == 0.5
    assert row["f1_macro"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert metrics.confusion_matrix(df, 4).count() == 16


def test_majority_tie_takes_the_lower_index(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,)], "target_index int")
    assert metrics.majority_class(df).first()["majority"] == 1


def test_losses_equal_numpy(spark):
    rng = np.random.default_rng(3)
    logits, y, w = rng.normal(size=(40, 5)) * 4, rng.integers(0, 5, 40), rng.uniform(0.5, 2, 5)
    df = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(logits, y)], "logits array<double>, y int")
    logp = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    own = logp[np.arange(40), y]
    eps = 0.1
    plain = -(1 - eps) * own - eps / 5 * logp.sum(axis=1)
    weighted = -(1 - eps) * own * w[y] - eps / 5 * (logp * w).sum(axis=1)
    focal = -((1 - np.exp(own)) ** 2) * own
    row = df.agg(
        scores.cross_entropy("logits", "y", 5, eps).alias("a"),
        scores.cross_entropy("logits", "y", 5, eps, list(w)).alias("b"),
        scores.focal_loss("logits", "y").alias("c"),
        scores.focal_loss("logits", "y", 2.0, list(w)).alias("d"),
    ).first()
    assert row["a"] == pytest.approx(plain.mean())
    assert row["b"] == pytest.approx(weighted.sum() / w[y].sum())
    assert row["c"] == pytest.approx(focal.mean())
    assert row["d"] == pytest.approx((focal * w[y]).mean())


# Published experiment table: id, val accuracy, val macro-F1, seconds, in published rank order.
PUBLISHED = [
    ("sk_logreg_32", 0.6571238348868176, 0.38160003715417934, 30.75023889541626),
    ("sk_logreg_32_bal", 0.5772303595206392, 0.36343033310923706, 31.51781463623047),
    ("sk_logreg_64_bal", 0.6171770972037284, 0.3506980386485289, 40.96692371368408),
    ("sk_logreg_64", 0.6338215712383488, 0.3360207150885139, 42.925692319869995),
    ("svm_64_bal", 0.6218375499334221, 0.29746953409041493, 265.27095127105713),
]
RUN_COLUMNS = "experiment_id string, val_accuracy double, val_f1_macro double, runtime_sec double, error string"


def test_published_ranks(spark):
    rows = [(*r, None) for r in reversed(PUBLISHED)] + [("failed", None, None, None, "boom")]
    table = spark.createDataFrame(rows, RUN_COLUMNS)
    ranked = runs.rank_runs(table)
    assert [(r["experiment_id"], r["rank_f1"]) for r in runs.sort_runs(ranked).collect()] == [
        (r[0], i + 1) for i, r in enumerate(PUBLISHED)
    ] + [("failed", None)]
    assert runs.select_best(table).first()["experiment_id"] == "sk_logreg_32"
    report = [r["line"] for r in runs.selection_report(table).orderBy("line_no").collect()]
    assert "- experiment_id: sk_logreg_32" in report


def test_ties_share_a_rank(spark):
    rows = [("a", 0.1, 0.5, 1.0, None), ("b", 0.2, 0.5, 1.0, None), ("c", 0.1, 0.4, 1.0, None)]
    ranked = runs.rank_runs(spark.createDataFrame(rows, RUN_COLUMNS)).collect()
    assert {r["experiment_id"]: r["rank_f1"] for r in ranked} == {"a": 1, "b": 1, "c": 3}


def test_report_of_failed_runs(spark):
    rows = [("a", None, None, None, "x"), ("b", None, None, None, "x"), ("c", None, None, None, "y")]
    lines = runs.selection_report(spark.createDataFrame(rows, RUN_COLUMNS)).orderBy("line_no").collect()
    assert [r["line"] for r in lines] == ["- x: 2", "- y: 1"]


def test_early_stop_compares_with_the_accepted_best(spark):
    f = [0.5, 0.5 + 6e-7, 0.5 + 12e-7, 0.4, 0.4, 0.4, 0.9]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(f)], "run string, epoch int, val_f1_macro double")
    row = runs.early_stop(df).first()
    assert (row["best_epoch"], row["epochs_ran"], row["stopped_early"]) == (3, 6, True)


def test_history_rules(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [("1", "a.png", "x", 0.5, "2024-01-01T00:00:00", "s/1.png"), ("2", "b.png", "x", 0.5, "2024-01-02T00:00:00", "")]
    first = spark.createDataFrame(rows, history.HISTORY_SCHEMA)
    history.append_history(first, path)
    history.append_history(first.withColumn("label", F.lit("again")), path)
    old = first.withColumnRenamed("id", "prediction_id").withColumn("prediction_id", F.lit("3")).drop("image_relpath").limit(1)
    history.append_history(old, path)
    stored = history.read_history(spark, path)
    assert {(r["id"], r["label"]) for r in stored.collect()} == {("1", "x"), ("2", "x"), ("3", "x")}
    assert [r["id"] for r in history.history_page(stored, 1, 0).collect()] == ["2"]
    assert history.get_prediction(stored, "1").first()["image_url"] == "/api/predictions/1/image"
    assert "image_relpath" not in history.public_history(stored).columns
    with pytest.raises(ValueError):
        history.history_page(stored, 201)
    assert history.clear_history(spark, path) == {"all_rows": 3, "deleted_rows": 1}
    assert history.read_history(spark, path).count() == 0
    assert history.read_history(spark, str(tmp_path / "none")).columns == history.COLUMNS


def test_page_bounds(spark):
    df = spark.createDataFrame([("b",), ("A",), ("c",)], "id string")
    rows = items.page(df, 2, 0).collect()
    assert [r["id"] for r in rows] == ["A", "b"] and rows[0]["total"] == 3 and rows[0]["has_more"]
    assert [r["id"] for r in items.page(items.search(df, " C "), 2, 0).collect()] == ["c"]
    with pytest.raises(ValueError):
        items.page(df, 0, 0)


def test_mask_metrics_of_empty_masks(spark):
    df = spark.createDataFrame([([0, 0], [0, 0]), ([1, 0], [0, 0]), ([1, 1], [1, 0])], "p array<int>, t array<int>")
    got = [(r["iou"], r["dice"]) for r in metrics.mask_metrics(df, "p", "t").collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (0.5, pytest.approx(2 / 3))]


@pytest.mark.parametrize("digits", [1, 2])
def test_history_folders_are_pruned(spark, tmp_path, capsys, monkeypatch, digits):
    monkeypatch.setattr(history, "PREFIX_DIGITS", digits)
    path = str(tmp_path / "folders")
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.lit("f").alias("filename"), F.lit("a").alias("label"), F.lit(0.5).alias("score"),
        F.lit("2024-01-01").alias("created_at"), F.lit("").alias("image_relpath"),
    )
    history.append_history(rows.where("id < 2500"), path)
    one = history.prefix_of("2600")
    batch = rows.where(history.id_prefix(F.col("id")) == one)
    stored = history.read_history(spark, path, [one])
    history.new_rows(batch, stored).explain()
    assert f"PartitionFilters: [isnotnull(_prefix#" in (shown := capsys.readouterr().out) and f"= {one})" in shown
    history.append_history(batch.withColumn("label", F.lit("again")), path)
    got = history.read_history(spark, path)
    late = [str(i) for i in range(2500, 3000) if history.prefix_of(str(i)) == one]
    assert got.count() == 2500 + len(late) and sorted(r["id"] for r in got.where("label = 'again'").collect()) == sorted(late)
    assert history.find_prediction(spark, path, late[0]).count() == 1 and history.find_prediction(spark, path, "x").count() == 0
    flat = str(tmp_path / "flat")
    rows.where("id < 10").write.parquet(flat)
    history.append_history(rows.where("id < 20"), flat)
    assert history.read_history(spark, flat).count() == 20
    history.clear_history(spark, path)
    history.append_history(rows.limit(5), path)
    assert history.read_history(spark, path).count() == 5
