import os

import pytest

from lakeglass.plans.guard import split_statements
from lakeglass.plans.sqlbox import GONE, NOTHING, SqlBox


@pytest.fixture(scope="module")
def box(spark):
    spark.createDataFrame([(1, 1, 10.0), (2, 1, 5.0), (3, 2, 7.5)], "id int, customer_id int, total double").createOrReplaceTempView("box_orders")
    return SqlBox(spark)


READS = ["SELECT {c} FROM {t}", "FROM {t}", "WITH w AS (FROM {t}) SELECT max({c}) AS m FROM w", "VALUES (1), (2)", "SHOW TABLES", "DESCRIBE {t}",
         "EXPLAIN SELECT {c} FROM {t}", "SUMMARIZE {t}", "SUMMARIZE SELECT {c} FROM {t}", "PRAGMA table_info({t})", "PIVOT {t} ON customer_id USING sum(total)",
         "SELECT (SELECT max({c}) FROM {t}) AS m", "FROM {t} |> WHERE {c} > 1", "SELECT 1 AS a; SELECT {c} FROM {t}"]
WRITES = ["CREATE TABLE never AS SELECT 1 AS a", "CREATE TEMPORARY VIEW never AS SELECT 1 AS a", "INSERT INTO {t} VALUES (9, 9, 9)", "DROP TABLE {t}", "CACHE TABLE {t}",
          "SET spark.sql.ansi.enabled = false", "RESET", "ADD JAR '/never.jar'", "INSERT OVERWRITE DIRECTORY '/never' USING parquet SELECT 1 AS a",
          "WITH w AS (SELECT 1 AS a) INSERT INTO {t} SELECT * FROM w", "EXECUTE IMMEDIATE 'DROP TABLE {t}'", "BEGIN SELECT 1; END", "SELECT TRANSFORM({c}) USING 'cat' FROM {t}"]
CALLS = ["reflect('java.lang.System', 'nanoTime')", "java_method('java.lang.System', 'nanoTime')", "system.builtin.reflect('java.lang.System', 'nanoTime')",
         "try_reflect('java.lang.System', 'nanoTime')", "REFLECT('java.lang.System', 'nanoTime')"]


@pytest.mark.parametrize("sql", READS)
def test_reads_run(box, sql):
    assert box.run(sql.format(t="box_orders", c="id"), 10).error is None


@pytest.mark.parametrize("sql", WRITES + [f"SELECT 1 AS a; {w}" for w in WRITES[:4]])
def test_writes_are_refused(box, sql):
    assert box.run(sql.format(t="box_orders", c="id"), 10).error
    assert box.run("SELECT count(*) AS n FROM box_orders", 10).page.first().n == "3"


@pytest.mark.parametrize("call", CALLS)
def test_calls_of_foreign_code_are_refused(box, call):
    many = ", ".join(f"{i} AS c{i}" for i in range(60))
    for sql in (f"SELECT {call} AS a", f"SELECT {many}, {call} AS a", f"SELECT (SELECT max(x) FROM (SELECT {call} AS x)) AS a", f"WITH w AS (SELECT {many}, {call} AS x) SELECT 1 AS a FROM w",
                f"SELECT id FROM box_orders WHERE id > 0 AND {call} = 'x'", f"EXPLAIN SELECT {many}, {call} AS a", f"PIVOT box_orders ON customer_id USING max({call})",
                f"SUMMARIZE SELECT {call} AS a", f"SELECT transform(array(1), x -> concat(x, {call})) AS a", f"DESCRIBE QUERY SELECT {call} AS a"):
        error = box.run(sql, 10).error
        assert error and "Not taken: the function" in error, (sql, error)


def test_functions_named_another_way_are_refused(box, spark):
    """By IDENTIFIER, by a view, by a SQL function: what a name stands for counts."""
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW box_foreign AS SELECT reflect('java.lang.System', 'nanoTime') AS a")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION box_foreign() RETURNS STRING RETURN java_method('java.lang.System', 'nanoTime')")
    for sql in ("SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime') AS a", "WITH w AS (SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'nanoTime') AS x) SELECT x FROM w",
                "SELECT a FROM box_foreign", "SELECT (SELECT max(a) FROM box_foreign) AS a", "SELECT box_foreign() AS a", "SUMMARIZE SELECT IDENTIFIER('java_method')('java.lang.System', 'nanoTime') AS a"):
        error = box.run(sql, 10).error
        assert error and "Not taken: the function" in error, (sql, error)
    assert box.run("SELECT IDENTIFIER('abs')(IDENTIFIER('id')) AS a FROM IDENTIFIER('box_orders')", 10).error is None


@pytest.mark.parametrize("sql", ["CALL x()", "CALL system.procedure(1)", "MERGE INTO box_orders USING box_orders AS b ON true WHEN MATCHED THEN DELETE", "DECLARE never INT", "SET VAR never = 1"])
def test_what_is_not_listed_is_refused(box, sql):
    assert "Not taken" in box.run(sql, 10).error


def test_explaining_by_running_is_refused(box):
    for sql in ("EXPLAIN ANALYZE SELECT 1", "explain /* x */ analyse select 1", "EXPLAIN (ANALYZE) SELECT 1"):
        assert "ANALYZE" in box.run(sql, 10).error


def test_blank_and_wrong_texts(box):
    assert box.run(" -- only a comment\n;;", 10).error == NOTHING
    assert box.run("SELEC 1", 10).error and box.run("SELECT nope FROM box_orders", 10).error


def test_errors_of_earlier_statements_count(box):
    assert "zero" in box.run("SELECT raise_error('zero') AS x; SELECT 1 AS a", 10).error
    assert box.run("PRAGMA table_info(nowhere); SELECT 1 AS a", 10).error


def test_split_keeps_quotes_and_comments():
    assert split_statements("select ';' ; -- ;\n select \"a;b\" /* ; */; ") == ["select ';'", '-- ;\n select "a;b" /* ; */']


def test_whole_results_are_kept(spark):
    box = SqlBox(spark)
    outcome = box.run("SELECT id, id % 7 AS k FROM range(250000)", 10)
    assert (outcome.shown_rows, outcome.kept_rows, outcome.truncated) == (10, 250_000, True)
    assert box.result(0).count() == 250_000 and box.filter(0, {"k": "=3"}).count() == 250_000 // 7
    exact = box.run("SELECT * FROM range(10)", 10)
    assert (exact.shown_rows, exact.kept_rows, exact.truncated) == (10, 10, False)


def test_files_of_old_results_go(spark, tmp_path):
    box = SqlBox(spark)
    box.run("SELECT 1 AS a", 1, 1)
    first = box._results[1][1]
    box.run("SELECT 2 AS a", 1, 2)
    second = box._results[2][1]
    assert not os.path.exists(first.removeprefix("file:")) and os.path.exists(second.removeprefix("file:"))
    box.drop(1)
    assert os.path.exists(second.removeprefix("file:"))
    box.drop(2)
    assert not os.path.exists(second.removeprefix("file:"))


def test_result_is_a_table(box):
    assert box.run("SELECT id AS a, total AS a FROM box_orders", 2, result_id=7).truncated
    rows = box.profile(7).collect()
    assert [(r.column, r.kind, r.distinct) for r in rows] == [("a", "integer", 3), ("a", "float", 3)]
    assert box.filter(7, [(1, ">5")]).count() == 2
    box.run("SELECT 1 AS one", 2, result_id=8)
    with pytest.raises(KeyError, match=GONE.rstrip(".")):
        box.profile(7)
    box.drop(7)
    assert box.result(8).count() == 1
    box.drop(8)
    with pytest.raises(KeyError):
        box.result(8)
    assert box.run("SELECT array(id) AS ids FROM box_orders", 5, 9).error is None
    assert box.profile(9).first().kind == "other"
