"""Inferred schema, stem sides and samples on small manifests."""

import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profile, resolve, schema


def audited(spark, names, images, masks=None):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, image string")
    paths = [spark.createDataFrame([(p,) for p in ps], "path string") for ps in (images, masks or [])]
    checked = resolve.audit(rows, paths[0], paths[1] if masks is not None else None, "image", "i", images_dir="img", masks_dir="msk")
    return checked, paths[0], paths[1] if masks is not None else None


def test_sides_count_repeated_empty_and_missing_names(spark):
    names = ["A.jpg", "a.png", "b", "", None, "c"]
    checked, images, masks = audited(spark, names, ["img/a.jpg", "img/x/A.png", "img/z.jpg"], ["msk/a_seg.png", "msk/y/a_seg.png"])
    stems = profile.stem_facts(checked, images, masks)
    got = profile.side_totals(stems).first().asDict()
    assert got == {
        "audit_total_rows": 6, "audit_images_missing": 4, "audit_masks_missing": 4, "disk_only_image_stems": 1,
        "csv_only_image_stems": 2, "csv_duplicate_stems": 2, "csv_duplicate_rows": 4, "disk_duplicate_image_stems": 1,
        "disk_duplicate_mask_stems": 1, "image_files_on_disk": 3, "mask_files_on_disk": 2,
    }
    samples = sorted(map(tuple, profile.one_sided(stems).collect()))
    assert samples == [
        ("csv_duplicate", "", 2), ("csv_duplicate", "a", 2), ("csv_only", "b", 1), ("csv_only", "c", 1),
        ("disk_duplicate_image", "a", 2), ("disk_duplicate_mask", "a_seg", 2), ("disk_only", "z", 1),
    ]
    assert profile.side_totals(profile.stem_facts(checked.limit(0), images.limit(0), masks.limit(0))).first()["audit_total_rows"] == 0


def test_without_masks_none_is_missing(spark):
    checked, images, masks = audited(spark, ["a", "b"], ["img/a.jpg"])
    found = schema.infer_schema(spark.createDataFrame([("a.jpg",)], "image string"))
    summary = profile.full_summary(checked, images, masks, found, {"images_dir": "img"}, ["i", "image"])
    rows = [tuple(r) for r in summary.collect()]
    assert [k for k, _ in rows] == list(profile.SUMMARY_KEYS) and len(rows) == 23
    assert dict(rows)["audit_masks_missing"] == "0" and dict(rows)["masks_dir"] == "None"
    assert dict(rows)["mode_inferred"] == "unknown" and dict(rows)["csv_rows"] == "2"


def test_samples_are_cut_in_the_tasks(spark):
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("v"), F.lit("x").alias("one"), F.col("id").alias("unique"))
    sample = profile.duplicate_sample(df, {"v": F.col("v"), "one": F.col("one"), "unique": F.col("unique")}, top=3)
    assert sorted(map(tuple, sample.collect())) == [("one", "x", 40_000), ("v", "0", 2), ("v", "1", 2), ("v", "10", 2)]
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()


def test_schema_roles(spark):
    rows = [("a.jpg", "a_seg.png", 1, 0, "7"), ("b.jpg", None, 0, 1, "x"), ("c.jpg", "", 0, 1, None)]
    df = spark.createDataFrame(rows, "image string, mask string, mel int, nv int, age string")
    got = schema.infer_schema(df).first()
    assert (got["image_col"], got["mode"], got["target_encoding"]) == ("image", "single_label", "one_hot_multiclass")
    assert got["mask_col"] == "image"  # 1.0 against 0.5 and the bonus
    assert (got["label_cols"], got["meta_cols"]) == (["mel", "nv"], ["mask", "age"])
    assert [tuple(r) for r in got["mask_candidates"]] == [("image", 1.0), ("mask", 0.65)]
    document = json.loads(schema.schema_document(schema.infer_schema(df)).first()["document"])
    assert document["columns"]["all_columns"] == df.columns and document["columns"]["label_cols"] == ["mel", "nv"]
    assert document["diagnostics"]["image_col_match"] is None


def test_schema_by_files(spark):
    df = spark.createDataFrame([("p1", "ISIC_1"), ("p2", "ISIC_2"), ("p3", "none")], "patient string, image string")
    files = spark.createDataFrame([("isic_1",), ("isic_2",), ("other",)], "stem string")
    got = schema.infer_schema(df, files).first()
    assert (got["image_col"], got["image_col_by_name"], round(got["image_col_match"], 6)) == ("image", None, 0.666667)
    assert (got["label_cols"], got["meta_cols"], got["mode"]) == ([], ["patient", "image"], "unknown")
    with pytest.raises(RuntimeError):
        schema.infer_schema(df, files.where("stem = 'other'"))
