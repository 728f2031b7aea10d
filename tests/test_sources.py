"""Files: manifests, images, masks, documents, sinks, streams."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.names import ALL_IMAGE_EXTS
from tallyframe.operators import features, models
from tallyframe.sources import documents, files, history, manifest, sinks
from tallyframe.streaming.ingest import ingest_history


@pytest.fixture
def odd_csv(tmp_path):
    """Semicolons, Latin-1, a blank line, a repeated id, an empty id, path forms."""
    text = "Image;Idade;Descrição\nimages/X.jpg;30;coração\n\nimages\\Y.png;1;b\n;9;c\nX;31;última\n"
    path = tmp_path / "manifest.csv"
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def test_odd_manifest(spark, odd_csv):
    assert manifest.sniff_sep(spark, odd_csv) == ";"
    assert manifest.count_records(spark, odd_csv) == 5
    df = manifest.read_manifest(spark, odd_csv)
    rows = {r["id"]: r["meta"] for r in manifest.manifest_index(df).collect()}
    assert set(rows) == {"X", "Y"}
    assert rows["X"] == {"Idade": "31", "Descrição": "última"}
    assert manifest.read_manifest(spark, odd_csv, normalize=True).columns[:3] == ["image", "idade", "descrio"]


def test_utf8_manifest_with_line_breaks(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('id,note\na,"one\ntwo"\nb,"say ""hi"""\nc,é\n', encoding="utf-8")
    rows = {r["id"]: r["note"] for r in manifest.read_manifest(spark, str(path)).collect()}
    assert rows == {"a": "one\ntwo", "b": 'say "hi"', "c": "é"}


def test_missing_sources_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert manifest.read_manifest(spark, gone).count() == 0
    assert manifest.count_records(spark, gone) == 0
    assert manifest.sniff_sep(spark, gone) == ","
    assert files.list_files(spark, gone).count() == 0


def test_last_row_wins_over_split_files(spark, tmp_path):
    path = str(tmp_path / "big.csv")
    with open(path, "w") as f:
        f.write("id,v\n")
        f.writelines(f"k{i % 100},{i}\n" for i in range(20000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = manifest.read_manifest(spark, path)
        assert df.rdd.getNumPartitions() > 4
        rows = {r["id"]: r["meta"]["v"] for r in manifest.manifest_index(df).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {f"k{i}": str(19900 + i) for i in range(100)}


def test_id_column():
    assert manifest.id_column(["x", " Image ", "id"]) == " Image "
    assert manifest.id_column(["x", "y"]) == "x"


def test_read_csv_splits(spark, tmp_path):
    for name in ("train", "val", "test"):
        (tmp_path / f"{name}.csv").write_text(f"image_path,target_index\n{name}.jpg,1\n")
    got = {(r["split"], r["image_path"]) for r in manifest.read_splits(spark, str(tmp_path)).collect()}
    assert got == {(n, f"{n}.jpg") for n in ("train", "val", "test")}


def test_listings(spark, image_dir):
    flat = files.sorted_files(files.list_files(spark, str(image_dir / "images"))).collect()
    assert [r["name"] for r in flat] == ["IMG_1.png", "IMG_2.PNG", "IMG_3.png"]
    assert flat[1]["ext"] == "png" and flat[1]["stem"] == "IMG_2"
    deep = files.list_files(spark, str(image_dir / "images"), ALL_IMAGE_EXTS, recursive=True)
    assert deep.count() == 4
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_fingerprint_and_bytes(spark, image_dir):
    path = image_dir / "images" / "IMG_1.png"
    row = files.file_fingerprint(spark, [str(path)]).first()
    assert row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    assert row["size_bytes"] == path.stat().st_size
    listed = files.list_files(spark, str(image_dir / "images"))
    got = files.fetch_bytes(spark, listed, ["IMG_1", "none"]).collect()
    assert [(r["id"], bytes(r["content"])) for r in got] == [("IMG_1", path.read_bytes())]
    with pytest.raises(ValueError):
        files.fetch_bytes(spark, listed, ["x"] * 201)


def by_name(df):
    return {r["path"].split("/")[-1]: r for r in df.collect()}


def test_images_are_rgb(spark, image_dir):
    got = by_name(files.read_images(spark, str(image_dir / "images")))
    assert set(got) == {"IMG_1.png", "IMG_2.PNG"}
    assert list(got["IMG_1.png"]["data"]) == [255, 0, 0, 0, 255, 0, 0, 0, 255, 10, 20, 30]


def test_masks_are_one_channel(spark, image_dir):
    masks = files.read_masks(spark, str(image_dir / "masks"))
    got = by_name(masks)
    assert list(got["IMG_1_segmentation.png"]["data"]) == [0, 255, 3, 0]
    sized = masks.withColumn("data", features.resize_nearest("data", "height", "width", F.lit(4), F.lit(4)))
    grown = np.array(list(by_name(sized)["IMG_1_segmentation.png"]["data"])).reshape(4, 4)
    assert (grown == np.kron([[0, 255], [3, 0]], np.ones((2, 2)))).all()
    ones = by_name(masks.withColumn("data", features.binarize_mask("data")))
    assert list(ones["IMG_1_segmentation.png"]["data"]) == [0, 1, 1, 0]


def jpeg(spark, path, tag=None):
    """A 16 x 8 JPEG, left half white, right half black, optionally with an orientation tag."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(8):
        for y in range(8):
            image.setRGB(x, y, 0xFFFFFF)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))
    if tag is not None:
        entry = b"\x01\x12\x00\x03\x00\x00\x00\x01" + tag.to_bytes(2, "big") + b"\0\0"
        body = b"Exif\0\0MM\0\x2a\0\0\0\x08\0\x01" + entry + b"\0\0\0\0"
        raw = path.read_bytes()
        path.write_bytes(raw[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + raw[2:])


def test_exif_orientation(spark, tmp_path):
    jpeg(spark, tmp_path / "plain.jpg")
    for tag in (1, 3, 6, 8):
        jpeg(spark, tmp_path / f"t{tag}.jpg", tag)
    got = by_name(files.read_images(spark, str(tmp_path), upright_exif=True))
    pixels = {n: np.array(list(r["data"])).reshape(r["height"], r["width"], 3)[..., 0] > 127 for n, r in got.items()}
    assert pixels["plain.jpg"].shape == (8, 16) and pixels["plain.jpg"][:, :8].all() and not pixels["plain.jpg"][:, 8:].any()
    assert (pixels["t1.jpg"] == pixels["plain.jpg"]).all()
    assert (pixels["t3.jpg"] == pixels["plain.jpg"][::-1, ::-1]).all()
    assert (pixels["t6.jpg"] == np.rot90(pixels["plain.jpg"], -1)).all()
    assert (pixels["t8.jpg"] == np.rot90(pixels["plain.jpg"])).all()


def test_turns_match_their_meaning():
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: a[::-1, ::-1].T, 8: np.rot90(a)}
    for tag, expected in want.items():
        assert (features.turned(a, tag) == expected).all(), tag


def test_shape_check(spark, image_dir):
    images = files.read_images(spark, str(image_dir / "images"))
    masks = files.read_masks(spark, str(image_dir / "masks"))
    stem = F.regexp_extract("path", r"(IMG_\d)", 1)
    got = {r["stem"]: r["same_size"] for r in features.shape_check(images, masks, stem).collect()}
    assert got == {"IMG_1": True, "IMG_2": False}


def test_undecodable_files_become_error_records(spark, image_dir):
    folder = str(image_dir / "images")
    rows = models.input_errors(files.list_files(spark, folder), files.read_images(spark, folder)).collect()
    assert [(r["path"].split("/")[-1], r["code"]) for r in rows] == [("IMG_3.png", "INVALID_INPUT")]


def test_image_features(spark, image_dir):
    images = files.read_images(spark, str(image_dir / "images"))
    got = by_name(features.image_features(images, size=None))["IMG_1.png"]["features"]
    px = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 20, 30]])
    want = [np.histogram(px[:, c], bins=16, range=(0, 256), density=True)[0] for c in range(3)]
    want = np.concatenate([*want, (px / 255).mean(axis=0), (px / 255).std(axis=0)])
    assert len(got) == 54 and np.allclose(got, want, atol=1e-6)
    assert len(by_name(features.flatten_images(images, 8))["IMG_2.PNG"]["features"]) == 8 * 8 * 3


def test_resizing_keeps_flat_areas_and_means():
    rng = np.random.default_rng(0)
    flat = np.full((9, 7, 3), 77, dtype=np.uint8)
    noise = rng.integers(0, 255, (64, 48, 3)).astype(np.uint8)
    for kind in ("nearest", "bilinear", "bicubic"):
        assert (features.resize_pixels(flat, 16, 16, kind) == 77).all()
        assert features.resize_pixels(noise, 8, 6, kind).shape == (8, 6, 3)
    assert abs(features.resize_pixels(noise, 8, 6, "bilinear").mean() - noise.mean()) < 2


def test_image_tensor(spark, image_dir):
    got = by_name(features.image_tensor(files.read_images(spark, str(image_dir / "images")), 2))["IMG_1.png"]["tensor"]
    px = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [10, 20, 30]]]) / 255
    want = ((px - features.CHANNEL_MEAN) / features.CHANNEL_STD).transpose(2, 0, 1).reshape(-1)
    assert np.allclose(got, want, atol=1e-5)


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "doc")
    df = spark.createDataFrame([("a", [1, 2])], "name string, xs array<int>")
    documents.write_json_doc(df, path)
    assert documents.read_json_doc(spark, path).first()["xs"] == [1, 2]
    assert documents.read_json_text(spark, path).first()["document"].strip() == '{"name":"a","xs":[1,2]}'
    (tmp_path / "pretty.json").write_text('{\n "k": {"v": 3}\n}')
    assert documents.read_json_doc(spark, str(tmp_path / "pretty.json")).first()["k"]["v"] == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x', None), ("", "é", "z")], "a string, b string, c string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert {r["b"] for r in back} == {'q"x', "é"}
    lines = spark.createDataFrame([(2, "second"), (1, "first")], "line_no int, line string")
    sinks.write_report(lines, str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["first", "second"]
    sinks.write_scores(spark.createDataFrame([([1.5], 2)], "logits array<float>, target_index long"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).dtypes == [("logits", "array<double>"), ("target_index", "int")]


def test_ingest_adds_each_id_once(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    row = spark.createDataFrame([("1", "a", "x", 0.5, "2024", "")], history.HISTORY_SCHEMA)
    row.write.parquet(source)
    ingest_history(spark, source, target, log).awaitTermination()
    row.unionByName(row.withColumn("id", F.lit("2"))).write.mode("append").parquet(source)
    ingest_history(spark, source, target, log).awaitTermination()
    ingest_history(spark, source, target, log).awaitTermination()
    assert sorted(r["id"] for r in history.read_history(spark, target).collect()) == ["1", "2"]


def test_stamped_predictions(spark):
    scored = models.constant_scorer(spark.createDataFrame([("a.png", ".png"), ("b.jpg", ".jpg")], "filename string, ext string"))
    rows = models.stamp_predictions(scored, "store/").collect()
    assert len({r["id"] for r in rows}) == 2
    for r in rows:
        assert r["image_relpath"].startswith("store/" + r["id"]) and r["label"] == "suspeita" and r["score"] == 0.71
        assert r["created_at"].endswith("+00:00") and len(r["created_at"]) == 32


def test_grid_records_failures(spark):
    rows = [(i, [float(i % 2) * 3 + i * 0.01, 1.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x array<double>, target_index int")
    configs = {"ok": {"family": "logreg", "max_iter": 10, "class_weight": "balanced"}, "bad": {"family": "nope"}}
    got = {r["experiment_id"]: r for r in models.run_grid(configs, df, df, 2).collect()}
    assert got["ok"]["val_accuracy"] == 1.0 and got["ok"]["error"] is None
    assert got["bad"]["val_f1_macro"] is None and "nope" in got["bad"]["error"]
    svm = models.fit_linear_svm(df, 2, max_iter=5).transform(df)
    assert svm.where("y_pred = target_index").count() == 40
    sure = models.predict_proba(models.fit_logreg(df, 2), df).first()
    assert sum(sure["probability"]) == pytest.approx(1.0) and sure["confidence"] == max(sure["probability"])
