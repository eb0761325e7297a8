import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeglass.operators import catalog, dbt, joins, ranges, snapshots, table as tables
from lakeglass.operators.ranges import Range
from lakeglass.operators.profile import profile
from lakeglass.operators.summarize import summarize
from lakeglass.sources import csv as csv_source, files, tsv



def node(kind, name, package, path, schema, **more):
    return {"resource_type": kind, "name": name, "package_name": package, "original_file_path": path, "schema": schema} | more


def manifest_of(parts):
    """One manifest over rows of ``part``: a model per part, a source per brand, one test, and entries that lack fields."""
    nodes = {f"model.lab.p{p}": node("model", f"P{p}", "lab" if p % 2 else "guest", f"models\\{brand}\\p{p}.sql", brand.lower(), alias=f"Part_{p}", database=["LAKE", None, "pond"][p % 3],
                                     config={"materialized": "ephemeral" if p % 5 == 0 else "table"},
                                     columns={"P_Size": {"description": f"\u00a0 size of {p}\t"}, "p_brand": {"description": " "}, "p_name": {"description": "n" * (3000 + p)}})
             for p, brand in parts}
    nodes["test.lab.check"] = node("test", "check", "lab", "tests/check.sql", "audit")
    nodes["model.lab.bare"] = {"resource_type": "model", "name": "bare"}
    sources = {f"source.lab.{brand}": node("source", brand, "lab", "models/brands.yml", "Brands", identifier=f"raw_{brand}", columns={"p_size": {"description": "as delivered"}})
               for brand in sorted({b for _, b in parts})}
    return {"nodes": nodes, "sources": sources}


@pytest.fixture(scope="module")
def parts(table):
    return [(r.p_partkey, r.p_brand) for r in table("part").where("p_partkey < 30").orderBy("p_partkey").collect()]


@pytest.fixture(scope="module")
def nodes(spark, parts, tmp_path_factory):
    path = tmp_path_factory.mktemp("dbt") / "manifest.json"
    path.write_text(json.dumps(manifest_of(parts), indent=1))
    return dbt.manifest_relations(dbt.read_manifest(spark, str(path)))


def test_manifest(spark, nodes, parts):
    rows = {r.node_id: r for r in nodes.collect()}
    brands = {b for _, b in parts}
    assert len(rows) == len(parts) + len(brands) + 1 and "model.lab.bare" not in rows
    for p, brand in parts:
        assert (rows[f"model.lab.p{p}"].relation_key, rows[f"model.lab.p{p}"].original_file_path) == (f"{brand.lower()}.part_{p}", f"models/{brand}/p{p}.sql")
    assert all(rows[f"source.lab.{b}"].relation_key == f"brands.raw_{b}".lower() for b in brands) and rows["test.lab.check"].relation_key is None
    text = spark.createDataFrame([(json.dumps(manifest_of(parts)),)] * 2, "manifest string")
    assert dbt.manifest_relations(dbt.parse_manifest(text)).count() == 2 * len(rows)
    found = {(r.node_id, r.column): r.description for r in dbt.column_descriptions(nodes).collect()}
    assert found == {(f"model.lab.p{p}", "P_Size"): f"size of {p}" for p, _ in parts} | {(f"model.lab.p{p}", "p_name"): "n" * (3000 + p) for p, _ in parts} | {
        (f"source.lab.{b}", "p_size"): "as delivered" for b in brands}


def test_dbt_lookups(spark, nodes, parts):
    built = {(brand.upper(), f"PART_{p}") for p, brand in parts if p % 4}
    tables_there = spark.createDataFrame(sorted(built), "schema string, name string")
    paths = [(f"models/{b}/p{p}.sql",) for p, b in parts] + [("models/brands.yml",), ("models/none.sql",), ("tests/check.sql",)]
    outcome = {r.path: r.outcome for r in dbt.preview_outcomes(spark.createDataFrame(paths, "path string"), nodes, tables_there, "lab").collect()}
    for p, b in parts:
        want = "not-a-model" if p % 2 == 0 or p % 5 == 0 else "shown" if p % 4 else "missing-table"
        assert outcome[f"models/{b}/p{p}.sql"] == want
    assert [outcome[p] for (p,) in paths[-3:]] == ["not-sql", "not-a-model", "not-a-model"]
    hit = {r.name: r.node_id for r in dbt.node_for_table(tables_there, nodes, "lake", "lab").collect()}
    assert hit == {f"PART_{p}": f"model.lab.p{p}" for p, _ in parts if p % 4 and p % 3 != 2}


def test_descriptions_of_one_relation(spark, nodes, parts):
    p, brand = parts[3]
    plain = profile(spark.createDataFrame([(1, "a", "b")], "p_SIZE int, P_Name string, P_BRAND string"))
    described = dbt.with_descriptions(plain, dbt.column_descriptions(nodes), f"{brand}.PART_{p}").collect()
    assert [r.description for r in described] == [f"size of {p}", "n" * (3000 + p), None]
    twice = dbt.column_descriptions(nodes).union(dbt.column_descriptions(nodes).withColumn("node_id", F.lit("z")).withColumn("description", F.lit("later")))
    again = dbt.with_descriptions(plain, twice, f"{brand}.part_{p}")
    assert [r.description for r in again.collect()] == [r.description for r in described]
    assert dbt.coverage(again).first().described == 2
    assert dbt.coverage(dbt.with_descriptions(plain, twice, "nowhere.at_all")).first().described == 0


def test_catalog(spark):
    found = spark.createDataFrame([("default", "orders", "table", 3), ("marts", "orders", "table", 5), ("marts", "Daily", "view", None), ("sys", "x", "table", 1)], catalog.RELATION_COLUMNS)
    assert [r.id for r in catalog.relations(found).collect()] == ["orders", "marts.Daily", "marts.orders"]
    assert [r.id for r in catalog.search(found, " DAI ").collect()] == ["marts.Daily"]
    assert {r.schema: r.matches for r in catalog.search_counts(found, "o").collect()} == {"default": 1, "marts": 1}
    targets = spark.createDataFrame([("MARTS", "daily"), (None, "Orders"), ("marts", "nope")], "schema string, name string")
    got = {(r.target_schema, r.target_name): (r.schema, r.name) for r in catalog.resolve(targets, found).collect()}
    assert got == {("MARTS", "daily"): ("marts", "Daily"), ("default", "Orders"): ("default", "orders")}
    spark.range(3).createOrReplaceTempView("catalog_probe")
    assert "catalog_probe" in [r.name for r in catalog.session_relations(spark).collect()]


def test_ranges(spark):
    df = spark.createDataFrame([(0, "1", 2.0, "x"), (1, "3", None, ""), (2, " 5 ", 6.5, 'a"b\tc')], "i int, a string, b double, c string")
    facts = ranges.range_summary(df, [Range.cells((0, 0), (2, 1))], "i").first()
    assert (facts.cells, facts.sum, facts.min, facts.max) == (6, 17.5, 1.0, 6.5) and facts.label == "n = 6, total 17.5, mean 3.5, from 1 to 6.5"
    overlap = ranges.range_summary(df, [Range.rows(0, 1), Range.cols(0, 0)], "i").first()
    assert overlap.cells == 7 and overlap.sum is None and overlap.label == "n = 7"
    assert ranges.range_summary(df, [Range.cells((1, 1), (1, 1))], "i").first().label == ""
    lines = [r.line for r in ranges.tsv_lines(df, Range.rows(1, 2), "i", header=True).collect()]
    assert lines == ["a\tb\tc", "3\t\t", ' 5 \t6.5\t"a""b\tc"']
    blocks = [(r.block, r.line) for r in ranges.tsv_lines(df, [Range.cells((0, 0), (1, 0)), Range.cells((2, 1), (2, 1)), Range.cols(0, 1)], "i", header=True).collect()]
    assert blocks == [(0, "a"), (0, "1"), (0, "3"), (1, "6.5"), (2, "1\t2"), (2, "3\t"), (2, " 5 \t6.5")]


def test_display_text(spark):
    xs = [10.0, 0.1, 1e-7, 1e21, 1.5e300, 123456789012345680000.0, -0.5, 0.0, 1e15, float("nan"), float("-inf"), 2.5e-6]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    assert [r.x for r in tables.shown_text(df).collect()] == [
        "10", "0.1", "1e-7", "1e+21", "1.5e+300", "123456789012345680000", "-0.5", "0", "1000000000000000", "NaN", "-Infinity", "0.0000025"]
    odd = spark.sql("SELECT CAST(0.1 AS FLOAT) f, X'00FF' b, named_struct('x', 1, 'y', CAST(NULL AS STRING)) s, true t, CAST(NULL AS INT) n, "
                    "TIMESTAMP'2024-01-01 10:30:00' ts, CAST(1.5 AS DECIMAL(10,2)) d")
    assert tuple(tables.shown_text(odd).first()) == ("0.1", "00ff", '{"x":1,"y":null}', "true", "", "2024-01-01 10:30:00", "1.50")
    assert tables.shown_text(odd, "iso").first().ts == "2024-01-01T10:30:00.000Z"


def test_row_index_sort_and_find(spark, table):
    orders = table("orders")
    spread = tables.with_row_index(orders, ["o_orderkey"])
    want = orders.selectExpr("o_orderkey", "row_number() OVER (ORDER BY o_orderkey) - 1 AS want")
    assert spread.join(want, "o_orderkey").where("row_index <> want").count() == 0 and spread.count() == orders.count()
    df = spark.createDataFrame(enumerate(["10", "9", "", "b", "1e1", None, "a"]), "i int, v string")
    assert [r.i for r in tables.sort_rows(df, "v", ["i"]).collect()] == [1, 0, 4, 6, 3, 2, 5]
    assert [r.i for r in tables.sort_rows(df, "v", ["i"], descending=True).collect()] == [3, 6, 0, 4, 1, 2, 5]
    assert [(r.row_id, r.column) for r in tables.find(df, "1", "i").collect()] == [(0, "v"), (1, "i"), (4, "v")]
    assert tables.find_count(df, "1", "i").first().cells == 3
    assert tables.clamp_rows(0.5) == 1 and tables.clamp_rows(None) is None and tables.clamp_rows(2.9) == 2
    assert tables.head(df, 2, ["i"]).count() == 2 and tables.size_facts(df, 2).first().truncated


def test_asof_join_with_a_dominant_key(spark):
    rng = random.Random(5)
    right = [(rng.choice([1, 1, 1, 2]), rng.randrange(400), rng.choice([None, i])) for i in range(600)]
    left = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(420), i) for i in range(800)]
    l = spark.createDataFrame(left, "k int, at int, id int")
    r = spark.createDataFrame(right, "k int, at int, v int")
    got = {x.id: x.v for x in joins.asof_join(l, r, "k", "at", ["v"]).collect()}
    low = lambda v: -1 if v is None else v
    for k, at, i in left:
        best = max(((a, low(v)) for kk, a, v in right if kk == k and a <= at), default=(0, -1))
        assert low(got[i]) == best[1], (k, at, i)
    assert len(got) == len(left)


def test_asof_join_of_nulls_and_odd_names(spark):
    l = spark.createDataFrame([(None, 5, 1), (1, None, 2), (1, 5, 3), (1, 0, 4)], "`my id` int, `at` int, `x.y` int")
    r = spark.createDataFrame([(None, 3, "a"), (1, None, "b"), (1, 4, "c")], "`my id` int, `at` int, `a b` string")
    got = joins.asof_join(l, r, "my id", "at", ["a b"])
    assert got.columns == ["my id", "at", "x.y", "a b"] and sorted((x[2], x[3]) for x in got.collect()) == [(1, None), (2, None), (3, "c"), (4, None)]


def test_range_join(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(0, 100)) for i in range(200)]
    spans = [(i, s := rng.uniform(-5, 100), s + rng.choice([rng.uniform(-1, 15), 1e3, 1e12, 1e300, math.inf])) for i in range(80)] + [(90, -math.inf, 5.0), (91, -math.inf, math.inf)]
    got = joins.range_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, lo double, hi double"), "at", "lo", "hi", 7)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, at in points for s, lo, hi in spans if lo <= at < hi)
    odd = joins.range_join(spark.createDataFrame([(None,), (math.nan,), (3.0,)], "`a t` double"), spark.createDataFrame([(None, 9.0), (1.0, None), (1.0, math.nan), (2.0, 4.0)], "`l o` double, hi double"), "a t", "l o", "hi", 1)
    assert [tuple(r) for r in odd.collect()] == [(3.0, 2.0, 4.0)]


def test_snapshots(spark, tmp_path):
    start = datetime(2024, 1, 1)
    log = [("a" if i % 3 else "b" if i % 2 else None, start + timedelta(hours=7 * i), 1000 + i * i % 17) for i in range(60)]
    got = snapshots.snapshot_deltas(spark.createDataFrame(log, "relation string, at timestamp, rows bigint")).collect()
    last = {}
    want = {}
    for name, at, rows in log:
        want[(name, at)] = last.get(name)
        last[name] = rows
    assert {(r.relation, r.at): r.previous_rows for r in got} == want
    text = {r.summary for r in snapshots.snapshot_deltas(spark.createDataFrame(
        [("t", start, 1204), ("t", start + timedelta(1), 1310), ("t", start + timedelta(2), 1310), ("t", start + timedelta(3), 1300)],
        "relation string, at timestamp, rows bigint")).collect()}
    assert text == {None, "+106 rows (1,204 to 1,310)", "1,310 rows as before", "-10 rows (1,310 to 1,300)"}
    store = snapshots.ProfileStore(spark, str(tmp_path))
    first = store.get("x/y", "1", spark.range(3).toDF("id"))
    again = store.get("x/y", "1", spark.range(9).toDF("id"))
    assert first.first().rows == again.first().rows == 3 and store.get("x/y", "2", spark.range(9).toDF("id")).first().rows == 9
    assert len(store.get("x/y", "2", spark.range(90).toDF("id"), bins=5).first().histogram.counts) == 5 and len(store.get("x/y", "2", spark.range(90).toDF("id"), bins=10).first().histogram.counts) == 10
    broken = spark.range(3).selectExpr("raise_error('no such luck') AS id")
    for df in (broken, spark.range(3)):
        with pytest.raises(Exception, match="no such luck"):
            store.get("z", "1", df)


@pytest.mark.parametrize("text, columns, rows", [
    ("name,age\nAnn,3\nBob,4\n", ["name", "age"], [("Ann", "3"), ("Bob", "4")]),
    ("name;age\nAnn;3\n\nBob;4\n", ["name", "age"], [("Ann", "3"), ("Bob", "4")]),
    (" a | b \n1|2\n3\n4|5|6\n", ["a", "b"], [("1", "2"), ("3", ""), ("4", "5")]),
    ('a,b\n"x, ""y""",2\n', ["a", "b"], [('x, "y"', "2")]),
    ('a,b\n"two\nlines",2\n', ["a", "b"], [("two\nlines", "2")]),
    ("a,b\n", ["a", "b"], []), ("\n \n", [], []),
])
def test_csv(spark, tmp_path, text, columns, rows):
    path = tmp_path / "t.csv"
    path.write_text(text)
    if "two" in text:
        with pytest.raises(ValueError, match="line_breaks"):
            csv_source.read_csv(spark, str(path))
    df = csv_source.read_csv(spark, str(path), line_breaks="two" in text)
    assert df.columns == columns and [tuple(r) for r in df.collect()] == rows
    if rows:
        assert csv_source.has_line_breaks_in_cells(spark, str(path)) == ("two" in text)


def test_one_odd_line_does_not_decide_the_delimiter(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("a;b;c\n" + "1,5;2,5;3,5\n" * 500 + "broken, line\n" + "1;2;3\n" * 500)
    assert csv_source.sniff_delimiters(spark, str(path)).first().delimiter == ";"


def test_files_views_and_tsv(spark, tmp_path):
    assert [files.view_name(n) for n in ("x/y.z/orders.2024.csv", "a\\b.parquet", "\x07.csv", "  ", "noext")] == ["orders.2024", "b", ".csv".strip("."), "data", "noext"]
    (tmp_path / "a").mkdir()
    for folder in (tmp_path, tmp_path / "a"):
        (folder / "same.csv").write_text("x\n1\n")
    with pytest.raises(ValueError, match="same"):
        files.create_views(spark, [str(tmp_path / "same.csv"), str(tmp_path / "a" / "SAME.csv")])
    (tmp_path / "same.csv").unlink()
    df = spark.createDataFrame([(1, 'a\t"b"', None), (2, "x\ny", 0.5)], "i int, s string, d double").coalesce(1)
    tsv.write_tsv(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in tsv.read_tsv(spark, str(tmp_path / "out")).collect()) == [("1", 'a\t"b"', ""), ("2", "x\ny", "0.5")]
    (tmp_path / "typed.csv").write_text("i,d\n1,0.5\n")
    views = files.create_views(spark, files.list_files(spark, str(tmp_path), "*.csv"))
    assert list(views) == ["typed"] and spark.table("typed").dtypes == [("i", "int"), ("d", "double")]


def test_folders_of_files_are_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).repartition(2).write.parquet(str(tmp_path / "day=1" / "more.parquet"))
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "_hidden.parquet"))
    (tmp_path / "other").mkdir()
    listed = files.list_files(spark, str(tmp_path))
    assert [(files.view_name(p), spark.read.parquet(p).count()) for p in listed] == [("more", 4), ("many", 3)]


def test_snapshots_at_one_instant_follow_their_rows(spark):
    start = datetime(2024, 1, 1)
    log = [("a" if i % 2 else None, start + timedelta(hours=i // 8), i * 7 % 11) for i in range(64)]
    want = []
    for name in ("a", None):
        own = sorted((at, n) for relation, at, n in log if relation == name)
        want += [(name, at, before, n) for (at, n), before in zip(own, [None, *[n for _, n in own]])]
    for rows in (log, log[::-1], log[1::2] + log[::2]):
        got = snapshots.snapshot_deltas(spark.createDataFrame(rows, "relation string, at timestamp, rows bigint")).collect()
        assert sorted(((r.relation, r.at, r.previous_rows, r.rows) for r in got), key=repr) == sorted(want, key=repr)


def test_summarize(spark):
    rows = {r.column_name: r for r in summarize(spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "c")], "n int, s string")).collect()}
    assert rows["n"].avg == 2.5 and rows["n"].q50 == 2.0 and math.isclose(rows["n"].std, 1.2909944487358056)
    assert rows["s"].null_percentage == 25.0 and rows["s"].approx_unique == 2 and rows["s"].avg is None
