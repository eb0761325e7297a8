import math
import random
from datetime import date, datetime
from decimal import Decimal

import pytest

from lakeglass.operators.histogram import bins_of
from lakeglass.operators.profile import profile, profile_text, profile_variant, report

D = Decimal


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, 9007199254740993, 1.5, D("1.50"), True, date(2020, 1, 1), datetime(2020, 1, 1, 10), "b", b"\x00\xff", [1], None, 10),
        (2, 1, 2.5, D("2.25"), False, date(2021, 1, 1), datetime(2021, 6, 1, 12, 30), "a", b"\x00\xff", [2, 3], None, 20),
        (3, None, None, None, None, None, None, None, None, None, None, 30),
        (4, 3, 4.0, D("10.00"), True, date(2019, 1, 1), datetime(2019, 3, 1), "c", b"\x01", [], None, 40),
        (5, 4, math.nan, D("3.10"), False, date(2020, 1, 1), datetime(2020, 1, 1, 10), "a", None, [4], None, 50),
        (6, 5, math.inf, D("0.05"), True, date(2020, 6, 1), datetime(2020, 6, 1), "b", None, [5], None, 60),
    ]
    return spark.createDataFrame(rows, 'id int, big bigint, ratio double, amount decimal(10,2), flag boolean, day date, ts timestamp, '
                                       'label string, payload binary, tags array<int>, all_null int, `odd "name"` int')


def by_name(p):
    return {r.column: r for r in p.collect()}


def test_every_type(mixed):
    rows = profile(mixed).collect()
    assert [r.nulls for r in rows] == [0, 1, 1, 1, 1, 1, 1, 1, 3, 1, 6, 0]
    got = {r.column: r for r in rows}
    assert (got["big"].kind, got["big"].min, got["big"].max, got["big"].distinct) == ("integer", "1", "9007199254740993", 5)
    ratio = got["ratio"]
    assert (ratio.kind, ratio.min, ratio.max, ratio.distinct) == ("float", "1.5", "4", 5) and sum(ratio.histogram.counts) == 3
    assert math.isclose(ratio.mean, 8 / 3)
    assert (got["amount"].kind, got["amount"].min, got["amount"].max, got["amount"].native_type) == ("float", "0.05", "10.00", "DECIMAL(10,2)")
    assert (got["day"].kind, got["day"].min, got["day"].max) == ("date", "2019-01-01", "2021-01-01")
    assert (got["ts"].min, got["ts"].max) == ("2019-03-01 00:00:00", "2021-06-01 12:30:00")
    assert (got["label"].kind, got["label"].min, got["label"].max) == ("text", "a", "c")
    assert (got["flag"].kind, got["flag"].distinct, got["flag"].min) == ("boolean", 2, None)
    for name, native in (("payload", "BINARY"), ("tags", "ARRAY<INT>")):
        assert (got[name].kind, got[name].distinct, got[name].min, got[name].native_type) == ("other", None, None, native)
    empty = got["all_null"]
    assert (empty.kind, empty.nulls, empty.distinct, empty.min, empty.mean, empty.histogram) == ("integer", 6, 0, None, None, None)
    assert got['odd "name"'].max == "60"
    assert by_name(profile(mixed, ts_style="iso"))["ts"].min == "2019-03-01T00:00:00.000Z"


def test_empty_tables_views_and_repeated_names(spark, mixed):
    rows = profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.kind, r.rows, r.nulls, r.distinct, r.min) for r in rows] == [("integer", 0, 0, 0, None), ("text", 0, 0, 0, None)]
    counts = profile(mixed.groupBy("label").count()).collect()
    assert counts[0].nulls == 1 and counts[1].max == "2"
    assert [r.column for r in profile(spark.sql("SELECT 1 AS x, 'a' AS x")).collect()] == ["x", "x"]
    assert [r.kind for r in profile_text(spark.createDataFrame([], "a string")).collect()] == ["empty"]


def test_estimates(mixed):
    exact, estimated = by_name(profile(mixed)), by_name(profile(mixed, distinct="approx"))
    for name, row in exact.items():
        assert row.asDict() | {"distinct": 0} == estimated[name].asDict() | {"distinct": 0}
        assert row.distinct is None or abs(row.distinct - estimated[name].distinct) <= 1


def test_report(spark):
    df = spark.createDataFrame([(i, 7, "x" if i else None, date(2024, 1, 1 + i % 3)) for i in range(2000)], "id int, one int, t string, d date")
    got = by_name(report(profile(df)))
    assert got["id"].tag == "unique" and got["one"].tag == "constant" and got["id"].distinct_text == "2,000"
    assert got["t"].nulls_text == "1 (<0.1%)" and got["d"].date_range == "2024-01-01 → 2024-01-03" and got["id"].distinct_ratio == 1.0


def test_long_texts_stay_whole_and_are_told_apart(spark):
    texts = ["a" * 300 + "1", "a" * 300 + "2", "a" * 200, "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in (profile(df).first(), profile_text(df).first()):
        assert (row.distinct, row.min, row.max) == (4, min(texts), max(texts))
    long = df.where("length(t) > 200")
    assert profile(long).first().max == texts[1] and report(profile(long), text_chars=10).first().max == "a" * 10 + "…"


def test_long_numbers_count_whole(spark):
    rng = random.Random(4)
    numbers = [rng.choice([-1, 1]) * rng.randrange(10 ** (d - 1), 10**d) for d in (1, 5, 37, 38, 39, 40, 120, 120, 251, 300, 300)]
    row = profile_text(spark.createDataFrame([(str(n),) for n in numbers], "t string")).first()
    assert (row.kind, row.distinct, row.min, row.max) == ("integer", len(set(numbers)), str(min(numbers)), str(max(numbers)))
    close = [10**250 + k for k in range(5)] + [-(10**250) - k for k in range(5)]
    row = profile_text(spark.createDataFrame([(str(n),) for n in close], "t string")).first()
    assert (row.distinct, row.min, row.max) == (10, str(min(close)), str(max(close)))


def written_as(kind, rng):
    """A random value of a kind, and one way to write it."""
    if kind == "integer":
        return str(rng.randrange(-10**6, 10**6))
    if kind == "float":
        return rng.choice(["{:.3f}", "{:+.2f}", "{:.4e}"]).format(rng.uniform(-1e4, 1e4))
    if kind == "boolean":
        return rng.choice(["true", "FALSE", "True", "fAlse"])
    if kind == "date":
        day = date(2000, 1, 1 + rng.randrange(28))
        return day.isoformat() + rng.choice(["", "T10:20", " 10:20:30.5", "T24:00:00Z", "T01:02:03+05:30", "T01:02-0330"])
    return rng.choice(["007", "12-34", "2001-02-30", "2001-13-01", "x1", "1e", "yes", "2001-01-01T25:00", "2001-01-01T10:00+25:00", "+", "1_000"])


@pytest.mark.parametrize("kind", ["integer", "float", "boolean", "date", "text"])
def test_kinds_from_text(spark, kind):
    rng = random.Random(kind)
    cells = [written_as(kind, rng) for _ in range(60)]
    padded = [rng.choice(["", " ", "\t"]) + c + rng.choice(["", "  "]) for c in cells] + ["", "  ", None]
    row = profile_text(spark.createDataFrame([(c,) for c in padded], "c string")).first()
    assert (row.kind, row.nulls, row.rows) == (kind, 3, 63)
    if kind in ("integer", "float"):
        numbers = [float(c) for c in cells]
        assert row.distinct == len(set(numbers)) and float(row.min) == min(numbers) and float(row.max) == max(numbers) and math.isclose(row.mean, sum(numbers) / 60)
    if kind == "boolean":
        assert row.distinct == len({c.lower() for c in cells}) and row.min is None
    if kind == "text":
        assert (row.distinct, row.min, row.max, row.mean) == (len(set(cells)), min(cells), max(cells), None)
    other = profile_text(spark.createDataFrame([(c,) for c in [*cells, written_as({"text": "date"}.get(kind, "text"), rng)]], "c string")).first()
    assert other.kind == "mixed" and other.min is None and other.histogram is None


def test_instants_and_spellings(spark):
    kinds = lambda cells: (lambda r: (r.kind, r.distinct))(profile_text(spark.createDataFrame([(c,) for c in cells], "c string")).first())
    assert kinds(["2020-05-01T12:00:00+02:00", "2020-05-01T10:00Z", "2020-05-01 10:00"]) == ("date", 1)
    assert kinds(["2020-05-01T24:00", "2020-05-02"]) == ("date", 1) and kinds(["2.5", "2.50", "25e-1"]) == ("float", 1)
    assert kinds([" ", ""]) == ("empty", 0) and kinds(["1e999", "1"]) == ("float", 2)


def test_kinds_from_stored_values(spark):
    rows = [("1", "9007199254740993", "1.5", '"b"', "1"), ("2", "1", "2.5", '"a"', '"x"'), ("3", None, None, None, "2.5"),
            ("4", "3", "4.0", '"c"', None), ("5", "4", "10.0", '"a"', '"x"')]
    df = spark.createDataFrame(rows, "id string, big string, ratio string, label string, mixed string").selectExpr(
        *[f"parse_json({c}) AS {c}" for c in ("id", "big", "ratio", "label", "mixed")], "parse_json('{\"a\": 1}') AS nested")
    got = by_name(profile_variant(df))
    assert [got[c].kind for c in ("id", "big", "ratio", "label", "mixed", "nested")] == ["integer", "integer", "float", "text", "mixed", "other"]
    assert (got["mixed"].nulls, got["mixed"].distinct) == (1, 3) and got["big"].max == "9007199254740993"
    assert (got["ratio"].min, got["ratio"].max, got["label"].max) == ("1.5", "10", "c")


def test_bins_against_a_model(spark):
    rng = random.Random(3)
    columns = {f"i{k}": [rng.randrange(-5, [3, 9, 40, 1000][k]) for _ in range(300)] for k in range(4)}
    columns["f"] = [rng.uniform(-3, 70) for _ in range(300)]
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} {'double' if c == 'f' else 'int'}" for c in columns))
    bins = bins_of(profile(df)).collect()
    for name, xs in columns.items():
        lo, hi = min(xs), max(xs)
        n = 10 if name == "f" else min(10, hi - lo + 1)
        width = (hi - lo + (name != "f")) / n
        counts = [0] * n
        for x in xs:
            counts[min(n - 1, max(0, math.floor((x - lo) / width)))] += 1
        mine = sorted((b.bucket, b["count"], b.label, b.is_peak) for b in bins if b.column == name)
        assert [m[1] for m in mine] == counts and [m[3] for m in mine].index(True) == counts.index(max(counts))
        if name != "f":  # every value lies in the range its bin's label names
            for bucket, _, label, _ in mine:
                inside = [x for x in xs if min(n - 1, math.floor((x - lo) / width)) == bucket]
                edges = [int(e.replace(",", "")) for e in label.split("–")]
                assert all(edges[0] <= x <= edges[-1] for x in inside), (label, inside)


def test_stage_count_does_not_grow_with_columns(spark):
    plan = lambda n: profile(spark.range(9).selectExpr(*[f"id + {i} AS c{i}" for i in range(n)]))._jdf.queryExecution().executedPlan().toString()
    assert plan(4).count("Exchange") >= plan(30).count("Exchange") - 60
    wide = profile(spark.range(50).selectExpr(*[f"id % {i + 1} AS c{i}" for i in range(130)])).collect()
    assert [r.distinct for r in wide][:60] == [min(i + 1, 50) for i in range(60)]


def test_distinct_doubles_as_hundredths(spark):
    """Prices are shuffled as words of 64 neighbours; nothing that differs is taken for the same."""
    rng = random.Random(4)
    odd = [0.0, -0.0, 0.1, 0.1 + 0.2, 0.3, -0.01, 1e13, 1e13 + 0.01, 9.99e12, 1e300, -1e300, 5e-324, math.nan, math.inf, -math.inf, 1 / 3, 0.125, None]
    values = odd + [rng.randrange(-10**6, 10**6) / 100 for _ in range(500)] + [rng.uniform(-5, 5) for _ in range(200)] + [math.nextafter(i / 100, 9e9) for i in range(50)] + [i / 100 for i in range(50)]
    df = spark.createDataFrame([(x, None if x is None else float(i % 7)) for i, x in enumerate(values)], "x double, y double")
    got = by_name(profile(df))
    assert got["x"].distinct == len({x for x in values if x is not None and not math.isnan(x)}) + 1 and got["y"].distinct == 7
    prices = spark.range(20000).selectExpr("CAST(id % 6400 AS DOUBLE) / 100 AS price").coalesce(1)
    counted = profile(prices)
    assert by_name(counted)["price"].distinct == 6400
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan and "bit_count" in plan


def test_classes_of_variants_are_found_once(spark):
    df = spark.range(5).selectExpr("parse_json(CAST(id AS STRING)) AS a", "parse_json('\"x\"') AS b")
    plan = profile_variant(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant") <= 3 * plan.count("stack(2, 0, c0") + 6
