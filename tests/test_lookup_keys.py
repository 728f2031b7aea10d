"""Lookup keys of rows and files against trying every candidate in turn."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.names import ALL_IMAGE_EXTS, CANDIDATE_SUFFIXES, PROJECT_IMAGE_EXTS
from tallyframe.operators import resolve


def cut(name):
    base, dot, _ = name.rpartition(".")
    return base if dot and base else name


def first_path(paths, tries):
    return next((p for t in tries for p in [t] if p in paths), None)


def by_strategy(value, strategy, paths, folder):
    path = value.strip().replace("\\", "/")
    name = path.rsplit("/", 1)[-1]
    stem, absolute = cut(name), path.startswith("/")
    if not path:
        return None
    tries = [path] + ([f"{folder}/{name}"] if name else [])
    if strategy == "glob" and not absolute:
        tries.append(f"{folder}/{path}")
    exts = PROJECT_IMAGE_EXTS if strategy == "project" else ALL_IMAGE_EXTS
    if name:
        tries += [f"{folder}/{stem}.{e}" for e in exts]
    found = first_path(paths, tries)
    if found is None and strategy == "glob" and name:
        def starts(p):
            parts = p[len(folder) + 1 :].split(".")
            return p.startswith(folder + "/") and "/" not in p[len(folder) + 1 :] and any(
                ".".join(parts[:n]) == stem for n in range(1, len(parts))
            )
        found = min((p for p in paths if starts(p)), default=None)
    return found


def any_mask(stem, stems):
    s = stem.strip().lower()
    if not s:
        return None
    tries = [s + x for x in CANDIDATE_SUFFIXES] + [s[: -len(x)] for x in CANDIDATE_SUFFIXES if x and s.endswith(x)]
    return next((stems[t] for t in tries if t in stems), None)


NAMES = ["a", "A", "a.b", "a_mask", "a_lesion_mask", "a_lesion", "a b", "a _seg", "b-seg_mask", "_mask", "jpg", ".jpg", "c.v1", "c"]


@pytest.mark.parametrize("strategy", ["project", "glob"])
def test_images(spark, strategy):
    rng = random.Random(3)
    paths = {f"{rng.choice(['img', 'img/sub', '/abs', 'other'])}/{n}{rng.choice(['.jpg', '.png', '.tif', '.v2.jpg', '.JPG', ''])}" for n in NAMES * 4}
    values = ["", " ", "x.png", "/abs/a.jpg", "sub/a.png", "jpg"]
    values += [f"{f}{n}{e}" for n in NAMES for f in ("", "img/", "sub/", "/abs/") for e in ("", ".jpg", ".png", ".jpeg")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, image string")
    files = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    found = resolve.resolve_images(rows, files, "image", ["i"], strategy, images_dir="img")
    got = {r["i"]: r["resolved_path"] for r in found.collect()}
    assert got == {i: by_strategy(v, strategy, paths, "img") for i, v in enumerate(values)}


def test_masks(spark):
    rng = random.Random(5)
    stems = [n + x for n in ("a", "A", "b_mask", "a b", "a ", "") for x in CANDIDATE_SUFFIXES]
    files = sorted({f"{rng.choice(['msk', 'msk/sub'])}/{s}.png" for s in stems if rng.random() < 0.5})
    known = {}
    for path in files:
        known.setdefault(os.path.basename(path)[:-4].lower().strip(), path)
    asked = sorted({*stems, "a_mask_seg", "b", " ", "B_MASK_mask"})
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, stem string")
    found = resolve.resolve_masks(rows, spark.createDataFrame([(p,) for p in files], "path string"), "stem", ["i"])
    got = {r["i"]: r["mask_path"] for r in found.collect()}
    assert got == {i: any_mask(s, known) for i, s in enumerate(asked)}


def test_a_row_asks_few_keys(spark):
    rows = spark.createDataFrame([("Doc_1.jpg",), ("sub/Doc_2_seg",)], "image string")
    sizes = {
        s: [r["n"] for r in resolve.image_options(rows, "image", s, "img", "").select(
            F.size(F.filter("options", lambda o: o["key"].isNotNull())).alias("n")).collect()]
        for s in ("stem", "project", "glob")
    }
    assert sizes == {"stem": [2, 1], "project": [3, 3], "glob": [4, 5]}
    masks = resolve.mask_options(rows.select(F.lower("image").alias("s")), "s").select(F.size("options").alias("n"))
    assert [r["n"] for r in masks.collect()] == [1, 2]


def test_named_masks_come_first(spark):
    rows = spark.createDataFrame([(0, "a.jpg", "n.png"), (1, "a.jpg", "gone.png"), (2, "a.jpg", None), (3, "", "n.png")], "i int, image string, mask string")
    images = spark.createDataFrame([("img/a.jpg",)], "path string")
    masks = spark.createDataFrame([("msk/n.png",), ("msk/a_seg.png",)], "path string")
    got = resolve.audit(rows, images, masks, "image", "i", mask_col="mask", images_dir="img", masks_dir="msk").orderBy("row_idx")
    assert [(r["resolved_image_rel"], r["resolved_mask_rel"]) for r in got.collect()] == [
        ("img/a.jpg", "msk/n.png"), ("img/a.jpg", "msk/a_seg.png"), ("img/a.jpg", "msk/a_seg.png"), ("", "msk/n.png"),
    ]
