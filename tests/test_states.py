"""Profile states: merged, kept and followed; distinct counts by bitmaps."""

import math
import random
import shutil
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeglass.operators import states
from lakeglass.operators.profile import profile
from lakeglass.streaming import refresh

SCHEMA = "i bigint, d double, s string, b boolean, t timestamp, day date, m decimal(12,2), none void, list array<int>, `i` int"
EXACT = ["ordinal", "column", "kind", "native_type", "rows", "nulls", "min", "max"]


def rows(n=400):
    rng = random.Random(4)
    maybe = lambda x: None if rng.random() < 0.2 else x
    return [(maybe(rng.randrange(-50, 50)), maybe(rng.choice([0.0, -0.0, math.nan, math.inf, rng.uniform(-5, 5)])), maybe(rng.choice(["", "a", "é", "B" * 300])), maybe(True),
             maybe(datetime(1960, 1, 1) + timedelta(hours=rng.randrange(10**6))), maybe(date(1969, 12, 30) + timedelta(days=rng.randrange(5))),
             maybe(Decimal(rng.randrange(100)) / 4), None, maybe([1]), maybe(7)) for _ in range(n)]


def facts(p):
    return [tuple(r) for r in p.select(*EXACT, F.round("mean", 6)).orderBy("ordinal").collect()]


def test_merged_states_equal_a_fresh_profile(spark):
    made = rows()
    whole = spark.createDataFrame(made, SCHEMA)
    parts = [spark.createDataFrame(p, SCHEMA) for p in (made[:100], made[100:150], [], made[150:])]
    merged = states.merge_states(reduce(DataFrame.union, [states.states_of(p) for p in parts]), whole.schema)
    got, want = states.profile_of(merged, whole.schema), profile(whole)
    assert got.schema.simpleString() == want.schema.simpleString() and facts(got) == facts(want)
    for g, w in zip(got.orderBy("ordinal").collect(), want.orderBy("ordinal").collect()):
        assert g["distinct"] == w["distinct"] or abs(g["distinct"] - w["distinct"]) <= 0.05 * w["distinct"] + 1
        assert (g.histogram is None) == (w.histogram is None)
        if g.histogram:
            assert (g.histogram.lo, g.histogram.hi, sum(g.histogram.counts)) == (w.histogram.lo, w.histogram.hi, sum(w.histogram.counts))
            assert max(abs(a - b) for a, b in zip(g.histogram.counts, w.histogram.counts)) <= 0.04 * 400 + 1


def test_states_of_nothing_and_of_groups(spark):
    whole = spark.createDataFrame(rows(60), SCHEMA)
    none = states.profile_of(states.states_of(whole.limit(0)), whole.schema)
    assert facts(none) == facts(profile(whole.limit(0)))
    assert facts(states.profile_of(states.merge_states(states.states_of(whole).limit(0), whole.schema), whole.schema)) == facts(profile(whole.limit(0)))
    by = states.states_of(whole, "s")
    assert by.count() == whole.select("s").distinct().count()
    assert facts(states.profile_of(states.merge_states(by, whole.schema), whole.schema)) == facts(profile(whole))


def test_a_batch_reads_the_total_before_it_and_its_own_rows(spark, tmp_path):
    """Whatever lies further back may be gone."""
    schema = spark.range(1).schema
    store = states.StateStore(spark, str(tmp_path), schema)
    for n in range(4):
        store.add(n, spark.range(n * 10, n * 10 + 10))
        if n:
            shutil.rmtree(tmp_path / f"batch={n - 1:08d}")
    total = states.profile_of(store.total(3), schema).first()
    assert (total.rows, total.min, total.max, total.mean, total["distinct"]) == (40, "0", "39", 19.5, 40)


def test_followed_states(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.range(10).selectExpr("id", "id AS __batch").write.parquet(str(source))
    seen = []
    stream = lambda: spark.readStream.schema("id bigint, __batch bigint").parquet(str(source))
    run = lambda: refresh.follow_states(stream(), str(out), {"id": ">4"}, lambda n, so_far, p: seen.append((n, so_far, p))).awaitTermination()
    run()
    assert seen[0][1].columns == ["id", "__batch"] and seen[0][1].count() == 5
    shutil.rmtree(out / "rows" / "__batch=0")  # the next batch must not read it
    spark.range(10, 15).selectExpr("id", "id AS __batch").write.mode("append").parquet(str(source))
    run()
    assert [(n, p.first().rows, p.first().min, p.first().max) for n, _, p in seen] == [(0, 5, "5", "9"), (1, 10, "5", "14")]


def test_quartiles(spark):
    df = spark.range(20_001).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(NULL AS DOUBLE) AS none", "'t' AS t")
    got = {r.column: r for r in states.quartiles_of(states.states_of(df), df.schema).collect()}
    assert set(got) == {"x", "none"} and got["none"].q50 is None
    assert all(abs(got["x"][f"q{q}"] / 20_000 - q / 100) < 0.015 for q in (25, 50, 75))
    text = df.select("t")
    assert states.quartiles_of(states.states_of(text), text.schema).count() == 0


@pytest.mark.parametrize("values", [[-(2**63), 2**63 - 1, 0, -1, 63, 64, -64, -65, None], list(range(-200, 200)) * 2, [10**15 * i for i in range(-9, 9)]])
def test_distinct_whole_numbers_by_bitmaps(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(3)
    assert profile(df).first()["distinct"] == len({v for v in values if v is not None})


def test_bursts_before_and_after_1970(spark):
    """Slots are as long before the epoch as after it, in the batch and on the stream."""
    times = [datetime(1969, 12, 31, 23, 59, 59, 300_000) + timedelta(seconds=1.4 * i) for i in range(4)] + [datetime(1969, 12, 31, 12) + timedelta(seconds=0.5 * i) for i in range(9)]
    df = spark.createDataFrame([("k", t) for t in times], "k string, at timestamp")
    got = sorted(r.events for r in refresh.bursts(df, "k", "at").collect())
    session = sorted(r["count"] for r in df.groupBy("k", F.session_window("at", "750 milliseconds")).count().collect())
    assert got == session == [1, 1, 1, 1, 9]
