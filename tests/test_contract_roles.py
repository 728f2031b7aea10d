"""Contract values under their synonyms and parents."""

import json

from tallyframe.operators import contract


def roles(spark, *documents):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "i int, document string")
    return [r.asDict() for r in contract.contract_roles(df, keys=["i"]).orderBy("i").collect()]


def test_names_come_before_parents_and_parents_in_order(spark):
    got = roles(
        spark,
        {"path_col": "last", "target": {"image_col": "inner"}},
        {"data": {"image_col": "data"}, "columns": {"path_col": "columns"}},
        {"image_col": None, "schema": {"image_col": None, "image": "s"}},
        {"target": [{"image_col": "x"}], "columns": "image_col", "contract": {"image_column": "c"}},
    )
    assert [r["image_col"] for r in got] == ["last", "columns", "s", "c"]


def test_types_are_kept_and_checked(spark):
    got = roles(
        spark,
        {"label_cols": ["0", "1"], "image_col": "f", "mode": "single_label", "encoding": "one_hot_multiclass"},
        {"label_cols": "mel,nv", "columns": {"label_cols": ["a", "b"]}, "image_col": ["f"], "mode": 1},
        {"labels": ["only"], "image": "", "mode": "multi_label", "label_encoding": "other"},
        {"labels": [], "mask_policy": "soft", "mask": {"policy": "hard"}},
        {"labels": ["a", "b"], "image": "f", "mask": {"policy": "hard"}},
    )
    assert got[0]["label_cols"] == ["0", "1"] and got[0]["errors"] == "" and got[0]["warnings"] == ""
    assert got[1]["label_cols"] is None and got[1]["image_col"] is None and got[1]["mode"] is None
    assert got[1]["errors"] == "LABEL_COLS_INVALID|IMAGE_COL_INVALID|MODE_UNSUPPORTED"
    assert got[2]["errors"] == "LABEL_COLS_INVALID|IMAGE_COL_INVALID|MODE_UNSUPPORTED" and got[2]["warnings"] == "ENCODING_UNEXPECTED"
    assert got[3]["mask_policy"] == "soft" and got[4]["mask_policy"] == "hard"
    assert got[4]["mode"] == "single_label" and got[4]["errors"] == "" and got[4]["warnings"] == "MODE_ASSUMED|ENCODING_MISSING"


def test_documents_that_are_no_objects(spark):
    got = roles(spark, None, "", "{", "[1]", '"text"', "null", "{}")
    assert {(r["image_col"], r["label_cols"], r["mode"], r["errors"]) for r in got} == {
        (None, None, "single_label", "LABEL_COLS_INVALID|IMAGE_COL_INVALID")
    }
