from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lakeglass.operators.filters import filter_rows
from lakeglass.operators.profile import profile
from lakeglass.streaming import refresh

SF = "/root/testdata/sf0.001"
GAP = 3600.0


def stream_of(spark, name):
    schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(SF)


def test_filtered_stream_gives_the_batch_answer(spark, table, tmp_path):
    boxes = {"event_type": "!click", "value": ">10", "ts": ">=2024-01-05"}
    query = refresh.to_table(refresh.filtered_stream(stream_of(spark, "events"), boxes), str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t"))
    want = filter_rows(table("events"), boxes)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_follow_reprofiles_the_table_so_far(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(10).write.parquet(str(source))
    seen = []
    run = lambda: refresh.follow(spark.readStream.schema("id bigint").parquet(str(source)), str(tmp_path / "out"), {"id": ">4"},
                                 lambda n, so_far, p: seen.append((n, so_far.count(), p.first().max)))
    run().awaitTermination()
    spark.range(10, 15).write.mode("append").parquet(str(source))
    run().awaitTermination()
    assert seen == [(0, 5, "9"), (1, 10, "14")]


def test_bursts_on_a_stream_equal_the_batch(spark, table, tmp_path):
    events = table("events").select("user_id", F.col("ts").cast("timestamp").alias("t s")).withColumn("user_id", F.expr("nullif(user_id, 3)"))
    closing = spark.createDataFrame([(None, datetime(2030, 1, 1))], "user_id bigint, `t s` timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    closing.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    refresh.to_table(refresh.bursts(stream, "user_id", "t s", GAP), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t"))
    want = refresh.bursts(events.union(spark.createDataFrame([(1, None)], "user_id bigint, `t s` timestamp")), "user_id", "t s", GAP)
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_quiet_time(spark):
    start = datetime(2024, 1, 1)
    offsets = [0, 0.5, 1.2, 1.9499, 5, 5.75, 6.6] + [20 + 0.5 * i for i in range(70)]
    df = spark.createDataFrame([("f", start + timedelta(seconds=s)) for s in offsets], "path string, at timestamp")
    got = sorted((r.events, (r.burst_end - r.burst_start).total_seconds()) for r in refresh.bursts(df, "path", "at").collect())
    session = df.groupBy("path", F.session_window("at", "750 milliseconds")).count()
    assert sorted(g[0] for g in got) == sorted(r["count"] for r in session.collect())
