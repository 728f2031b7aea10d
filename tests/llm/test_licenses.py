import duckdb

from tallyframe.llm import licenses

FOLDER = "/root/testdata/sf0.01"


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, path string, line int")
    return {(r.id, r.licence, r.origin) for r in licenses.scan_licences(df).collect()}


def test_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{FOLDER}/pages.parquet')")
    want = sorted(duck.execute(licenses.SQL).fetchall(), key=repr)
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert sorted(map(tuple, licenses.scan_licences(pages).collect()), key=repr) == want


def test_inheritance_and_odd_rows(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "http://h/a/LICENSE", mit), (2, "http://h/a/b/c.py", "x = 1"), (3, "h/a/b/COPYING.txt", gpl), (4, "h/z.py?q=1#t", None),
        (5, None, mit), (6, "h/a/d.py", f"# {gpl}\ncode"), (7, "h/a/d.py", f"# {gpl}\ncode"), (8, "", "y"), (9, "h/a/b/LICENSES/deep/x", "licensed to kill"),
        (None, "h/a/q/", "<p>text</p>"), (10, "h/a/b", "y " * 50_000),
    ]
    assert scan(spark, rows) == {
        (1, "MIT", "h/a/LICENSE"), (2, "GPL-3.0", "h/a/b"), (3, "GPL-3.0", "h/a/b/COPYING.txt"), (4, None, None), (5, "MIT", None),
        (6, "GPL-3.0", "h/a/d.py"), (7, "GPL-3.0", "h/a/d.py"), (8, None, None), (9, "GPL-3.0", "h/a/b"), (None, "MIT", "h/a"), (10, "MIT", "h/a"),
    }
    assert scan(spark, []) == set()
