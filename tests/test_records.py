import random

import pytest

from tallyframe.sources import manifest, records

CELLS = ["", "a", "x y", '"q"', '"a,b"', '"l1\nl2"', '"say ""hi"" now"', '5" pipe', 'a"b"c', '""', '"a""b\n\n""\n"', "é", '"tail"junk', '"sp" ', '"r\r\nn"',
         '"bad" "worse"']


def whole(spark, path):
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return sorted(map(tuple, rows.collect()), key=repr)


def ours(spark, path):
    df = manifest.read_manifest(spark, path, ",")
    rows = [(r["_pos"], tuple(r)[:-1]) for r in df.collect()]
    return sorted((r for _, r in rows), key=repr), [r[0] for _, r in sorted(rows)]


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few dozen bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "200"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, value in keys.items():
        spark.conf.set(k, value)
    yield
    for k, value in old.items():
        spark.conf.set(k, value) if value is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(6))
def test_records_over_splits_equal_the_whole_file(spark, tmp_path, tiny_splits, seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n"])
    for name in "ab":
        rows = [",".join([f"k{name}{i}", rng.choice(CELLS), rng.choice(CELLS)]) for i in range(40)]
        if seed == 5 and name == "b":
            rows.append('last,"never closed,x\nand on')
        (tmp_path / f"{name}.csv").write_text(end.join(["id,v,w", *rows]) + (end if seed % 2 and seed != 5 else ""), newline="")
    got, order = ours(spark, str(tmp_path))
    assert got == whole(spark, str(tmp_path))
    assert [k for k in order if k.startswith("ka")] == [f"ka{i}" for i in range(40)]
    lines = records.text_lines(spark, str(tmp_path), "UTF-8")
    assert lines.rdd.getNumPartitions() > 10 and records.split_states(lines, ",")[0]


def test_one_odd_quote_among_many_lines(spark, tmp_path, tiny_splits):
    rows = [f"{i},plain {i}" for i in range(200)]
    rows[90] = '90,5" pipe'
    (tmp_path / "odd.csv").write_text("\n".join(["id,v", *rows]) + "\n")
    got, order = ours(spark, str(tmp_path / "odd.csv"))
    assert order == [str(i) for i in range(200)] and ("90", '5" pipe') in got


def test_other_encodings_and_line_ends(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes('id;v\n1;"é\nü"\n2;x\n'.encode("latin-1"))
    got = manifest.read_manifest(spark, str(tmp_path / "l.csv"), ";")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [("1", "é\nü"), ("2", "x")]
    (tmp_path / "r.csv").write_text('id,v\r1,5" x\r2,y\r', newline="")
    assert manifest.read_manifest(spark, str(tmp_path / "r.csv"), ",").count() == len(whole(spark, str(tmp_path / "r.csv")))


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('a,"b', True, False), ('"a""', True, False), ('x","y', True, True), ('""', False, True), ('" "', False, False),
    ('"a" ,"b', True, True),
])
def test_lines_map_states(line, outside, inside):
    assert (records.stays_open(line, ",", False), records.stays_open(line, ",", True)) == (outside, inside)


def test_separators_inside_quotes_do_not_count(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id;note\n1;"a;b"\n2;"c;d;e"\n')
    assert manifest.sniff_sep(spark, str(tmp_path / "s.csv")) == ";"
