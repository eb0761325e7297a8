"""Spans that overlap spans, and spans of any length that hold points."""

import math
import random
from datetime import datetime, timedelta

import pytest

from lakeglass.operators import joins

INF = math.inf


def overlapping(left, right):
    def good(s):
        return s[1] is not None and s[2] is not None and s[1] < s[2]

    return sorted((a[0], b[0]) for a in left for b in right if good(a) and good(b) and a[1] < b[2] and b[1] < a[2])


def pairs(df):
    return sorted((r[0], r[3]) for r in df.collect())


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([rng.randrange(-20, 20), rng.uniform(-20, 20), -INF])
        out.append((i, float(start), float(start + rng.choice([0, 1, 2, rng.uniform(-1, 9), INF])) if start > -INF else rng.choice([INF, 3.0, -INF])))
    return out + [(1000, None, 2.0), (1001, 1.0, None), (1002, 1.0, math.nan), (1003, math.nan, math.nan), (1004, 1.0, INF), (1004, 1.0, INF), (None, -0.0, 0.0), (1005, 0.0, 1.0), (1006, -1.0, -0.0)]


@pytest.mark.parametrize(("block", "run"), [(64, 4096), (2, 2), (1, 1)])
def test_against_all_pairs(spark, monkeypatch, block, run):
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "RUN", run)
    left, right = spans(1, 90), spans(2, 70)
    schema = "`i d` int, lo double, hi double"
    got = joins.span_overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "lo", "hi")
    assert got.columns == ["i d", "lo", "hi", "i d", "lo", "hi"]
    assert sorted(((r[0], r[3]) for r in got.collect()), key=repr) == sorted(overlapping(left, right), key=repr)


def test_times_whole_numbers_and_other_names(spark):
    rng, zero = random.Random(3), datetime(2024, 1, 1)
    times = [(i, t := zero + timedelta(hours=rng.randrange(100)), t + timedelta(hours=rng.randrange(30))) for i in range(60)]
    other = [(f"b{i}", a, b) for i, a, b in times[::2]]
    got = joins.span_overlap_join(spark.createDataFrame(times, "i int, a timestamp, b timestamp"), spark.createDataFrame(other, "name string, c timestamp, d timestamp"), "a", "b", "c", "d")
    assert got.columns == ["i", "a", "b", "name", "c", "d"] and pairs(got) == overlapping(times, other)
    whole = [(i, i % 13, i % 13 + i % 5) for i in range(60)]
    frame = spark.createDataFrame(whole, "i int, a bigint, b bigint")
    assert pairs(joins.span_overlap_join(frame, frame, "a", "b")) == overlapping(whole, whole)


def test_of_nothing(spark):
    none = spark.createDataFrame([], "i int, lo double, hi double")
    some = spark.createDataFrame([(1, -INF, INF)], none.schema)
    assert [joins.span_overlap_join(a, b, "lo", "hi").count() for a, b in ((none, none), (some, none), (none, some), (some, some))] == [0, 0, 0, 1]


def test_infinite_spans_fall_into_no_single_key(spark):
    """Spans without ends match the points of every block, each block a key of its own; nothing is compared pair by pair."""
    points = spark.range(3000).selectExpr("id", "CAST(id % 700 AS DOUBLE) AS at")
    ends = spark.range(50).selectExpr("id AS s", "CAST('-Infinity' AS DOUBLE) AS lo", "CAST('Infinity' AS DOUBLE) AS hi")
    joined = joins.range_join(points, ends, "at", "lo", "hi", 1.0)
    assert joined.count() == 3000 * 50
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "block" in plan
    physical = joins.span_overlap_join(ends, ends.toDF("t", "lo", "hi"), "lo", "hi")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_blocks_of_spans_are_not_broadcast(spark):
    """Few spans cover very many blocks, which must not meet in the driver."""
    points = spark.range(3000).selectExpr("id", "CAST(id % 700 AS DOUBLE) AS at")
    ends = spark.range(5).selectExpr("id AS s", "CAST('-Infinity' AS DOUBLE) AS lo", "CAST('Infinity' AS DOUBLE) AS hi")
    for joined, rows in ((joins.range_join(points, ends, "at", "lo", "hi", 1.0), 15000), (joins.span_overlap_join(ends, ends.toDF("t", "lo", "hi"), "lo", "hi"), 25)):
        assert len(joined.collect()) == rows
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan


def test_points_in_spans_of_all_lengths(spark):
    rng = random.Random(8)
    points = [(i, float(rng.randrange(60))) for i in range(150)]
    held = [(i, float(lo := rng.randrange(60)), lo + rng.choice([1.0, 5.5, 1e6, 1e300, INF])) for i in range(40)] + [(90, -INF, 5.0), (91, -INF, INF), (92, -1e300, 1e300)]
    got = joins.range_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(held, "s int, lo double, hi double"), "at", "lo", "hi", 2)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, at in points for s, lo, hi in held if lo <= at < hi)


def test_long_spans_have_few_rows_before_the_join(spark, monkeypatch):
    """Ranges of ranks are cut into blocks of several sizes: whole, none twice, little beyond the ends, and far fewer than there are smallest blocks."""
    rng, n = random.Random(4), 3_000_000
    ranges = [(0, n), (5, 6), (63, 65), (64, 128), (1000, 1_000_000)] + [(a := rng.randrange(n), rng.randrange(a + 1, n + 1)) for _ in range(40)]
    cut = spark.createDataFrame(ranges, "a long, b long").selectExpr("a", "b", f"filter({joins._pieces(n)}, p -> p.first < p.end) AS pieces").collect()
    for r in cut:
        sizes = [joins.BLOCK * joins.RUN**p.level for p in r.pieces]
        blocks = sorted((p.first * size, p.end * size) for p, size in zip(r.pieces, sizes))
        assert all(x[1] == y[0] for x, y in zip(blocks, blocks[1:]))
        assert 0 <= r.a - blocks[0][0] < joins.BLOCK and 0 <= blocks[-1][1] - r.b < joins.BLOCK
        assert sum(p.end - p.first for p in r.pieces) <= 2 * 15 * 2 + 200 and max(sizes) <= n // 64


@pytest.mark.parametrize(("block", "run"), [(2, 4), (4, 2)])
def test_blocks_of_several_sizes(spark, monkeypatch, block, run):
    for name, value in (("BLOCK", block), ("RUN", run), ("MOST_BLOCKS", 2)):
        monkeypatch.setattr(joins, name, value)
    points = spark.range(900).selectExpr("id", "CAST(id % 450 AS DOUBLE) AS at")
    held = [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate([(-INF, INF), (3, 400), (0, 450), (17, 18), (100, 260), (449, INF), (-INF, 1)])]
    got = joins.range_join(points, spark.createDataFrame(held, "s int, lo double, hi double"), "at", "lo", "hi", 0.5)
    assert sorted((r.id, r.s) for r in got.collect()) == sorted((i, s) for i in range(900) for s, lo, hi in held if lo <= i % 450 < hi)
    assert sorted(r.id for r in joins._ranked_join(points, spark.createDataFrame(held[:1], "s int, lo double, hi double"), "at", "lo", "hi", False).collect()) == list(range(900))


def test_long_spans_share_no_cell_of_all_points(spark):
    """A span with an end, but far longer than where the points are, is matched by ranks like one without."""
    points = spark.range(3000).selectExpr("id", "CAST(id % 700 AS DOUBLE) AS at")
    ends = spark.createDataFrame([(1, 0.0, 1e9), (2, 350.0, 1e9), (3, 5.0, 6.0), (4, 0.0, 600.0)], "s int, lo double, hi double")
    joined = joins.range_join(points, ends, "at", "lo", "hi", 1.0)
    assert sorted((r.id, r.s) for r in joined.collect()) == sorted((i, s) for i in range(3000) for s, lo, hi in [(1, 0, 1e9), (2, 350, 1e9), (3, 5, 6), (4, 0, 600)] if lo <= i % 700 < hi)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan and "array(0)" in plan.replace("[0]", "array(0)")
