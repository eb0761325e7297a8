"""CSV files whose cells hold line breaks, read in splits."""

import csv
import io
import random

import pytest

from lakeglass.sources import csv as source
from lakeglass.sources import tsv

CELLS = ["", "a", "x y", 'say "hi"', '"', '""', "two\nlines", "\n\n,;\n", "a,b", "a;b", "é\r\nü", "long " * 30 + "\n" + "q" * 60, 'end"\n"', "  pad "]


@pytest.fixture
def splits(spark):
    """A function that sets the size of splits in bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    held = {n: spark.conf.get(n, None) for n in names}

    def of(size):
        for name, value in zip(names, (size, 0, 1)):
            spark.conf.set(name, str(value))

    yield of
    for name, value in held.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(folder, rows, delimiter, end, header, name="t.csv"):
    out = io.StringIO()
    made = csv.writer(out, delimiter=delimiter, lineterminator=end, quoting=csv.QUOTE_ALL if delimiter == ";" else csv.QUOTE_MINIMAL)
    made.writerows([header, *rows])
    path = folder / name
    path.write_text(out.getvalue(), newline="")
    return str(folder)


@pytest.mark.parametrize(("size", "delimiter", "end", "header"), [(40, ",", "\n", ["h1", "h2", "h3"]), (97, ";", "\r\n", ["h\n1", "h2", "h3"]), (10**6, ",", "\r\n", ["h1", "h2", "h3"])])
def test_against_the_csv_module(spark, tmp_path, splits, size, delimiter, end, header):
    rng = random.Random(size)
    rows = [tuple(rng.choice(CELLS) for _ in range(3)) for _ in range(50)]
    path = written(tmp_path, rows, delimiter, end, header)
    splits(size)
    got = source.read_csv(spark, path, delimiter, line_breaks=True)
    assert got.columns == header and sorted(tuple(r) for r in got.collect()) == sorted(rows)
    assert (spark.read.text(path).rdd.getNumPartitions() > 20) == (size < 100)


def test_one_cell_over_many_splits_and_several_files(spark, tmp_path, splits):
    long = "\n".join(f"line {i}, of a cell" for i in range(60))
    for i in range(3):
        written(tmp_path, [(str(i), long), ("x", f"\n{i}")], ",", "\n", ["id", "text"], f"{i}.csv")
    splits(50)
    got = source.read_csv(spark, str(tmp_path), ",", line_breaks=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(str(i), long) for i in range(3)] + [("x", f"\n{i}") for i in range(3)])


def test_quotes_within_unquoted_cells_open_nothing(spark, tmp_path, splits):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,1\n"in\nside",2\nx"y,3\n\n  \n4\n5,6,7\n')
    splits(9)
    got = source.read_csv(spark, str(tmp_path), ",", line_breaks=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted([('5" pipe', "1"), ("in\nside", "2"), ('x"y', "3"), ("  ", ""), ("4", ""), ("5", "6")])


def test_other_line_ends_and_odd_files(spark, tmp_path):
    (tmp_path / "cr.csv").write_bytes(b'a,b\r"x\ry",1\rz,2\r')
    got = source.read_csv(spark, str(tmp_path / "cr.csv"), ",", line_breaks=True)
    assert sorted(tuple(r) for r in got.collect()) == [("x\ry", "1"), ("z", "2")]
    (tmp_path / "open.csv").write_text('﻿a,b\n1,"never closed\n2,3\n')
    got = source.read_csv(spark, str(tmp_path / "open.csv"), ",", line_breaks=True)
    assert got.columns == ["a", "b"] and got.count() == 1
    (tmp_path / "head.csv").write_text("a,b\n")
    assert source.read_csv(spark, str(tmp_path / "head.csv"), ",", line_breaks=True).count() == 0


def test_types_of_columns_with_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,l,d,day,at,flag,text,none\n1,9999999999,0.5,2024-01-02,2024-01-02 03:04:05,true,"a\nb",\n2,3,7,2023-01-02,2024-01-02 00:00:00,false,1,\n')
    got = source.read_csv_typed(spark, str(tmp_path / "t.csv"), line_breaks=True)
    assert [t for _, t in got.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    assert got.where("i = 1").first().text == "a\nb" and got.where("none IS NULL").count() == 2


def test_text_is_shuffled_once(spark, tmp_path):
    written(tmp_path, [("x\ny", "1")], ",", "\n", ["a", "b"])
    plan = source.records(spark, str(tmp_path), ",")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_tsv_goes_the_same_way(spark, tmp_path, splits):
    df = spark.createDataFrame([(i, f"a\t{i}\n\"b\"") for i in range(40)], "i int, s string").coalesce(1)
    tsv.write_tsv(df, str(tmp_path / "out"))
    splits(60)
    assert sorted(tuple(r) for r in tsv.read_tsv(spark, str(tmp_path / "out")).collect()) == sorted((str(i), f"a\t{i}\n\"b\"") for i in range(40))
