"""Following tables that change: filtered streams, re-profiling and bursts of change events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import runtime
from ..operators.filters import Boxes, filter_rows
from ..operators.joins import quoted
from ..operators.profile import profile
from ..operators.states import StateStore, profile_of

# Fixed value: the quiet time that ends a burst of changes.
QUIET_SECONDS = 0.75


def filtered_stream(stream: DataFrame, boxes: Boxes) -> DataFrame:
    """The filter of a batch table on a stream: stateless, row by row."""
    return filter_rows(stream, boxes)


def to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def follow(stream: DataFrame, folder: str, boxes: Boxes, on_refresh: Callable[[int, DataFrame, DataFrame], None], **trigger) -> StreamingQuery:
    """Keep the matching rows of a stream as a table and report its profile after every batch.

    Batch ``n`` is written to its own sub-folder, so a repeated batch replaces itself. Then
    ``on_refresh(batch_id, table, profile)`` sees the table of all batches so far.
    """
    spark = stream.sparkSession
    matched = filter_rows(stream, boxes)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id:08d}")
        so_far = spark.read.schema(matched.schema).parquet(*[f"{folder}/rows/batch={i:08d}" for i in range(batch_id + 1)])
        on_refresh(batch_id, so_far, profile(so_far))

    return (
        matched.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def follow_states(stream: DataFrame, folder: str, boxes: Boxes, on_refresh: Callable[[int, DataFrame, DataFrame], None], **trigger) -> StreamingQuery:
    """As ``follow``, but a batch costs its own rows: its profile state is merged with that of the batches before it.

    Distinct counts and histograms are then estimates, as ``operators.states`` says. ``on_refresh(batch_id, table, profile)`` gets the
    table of all batches so far, which is read only if it is used.
    """
    spark, part = stream.sparkSession, "__batch"
    matched = filter_rows(stream, boxes)
    store = StateStore(spark, f"{folder}/states", matched.schema)
    columns = T.StructType([*by_ordinal_schema(matched.schema), T.StructField(part, T.IntegerType())])

    def refresh(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/rows/{part}={batch_id}"
        batch.toDF(*columns.names[:-1]).write.mode("overwrite").parquet(path)
        own = spark.read.schema(T.StructType(columns.fields[:-1])).parquet(path).toDF(*matched.columns)
        state = store.add(batch_id, own)
        so_far = spark.read.schema(columns).parquet(f"{folder}/rows").where(F.col(part) <= batch_id).drop(part).toDF(*matched.columns)
        on_refresh(batch_id, so_far, profile_of(state, matched.schema))

    return (
        matched.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def by_ordinal_schema(schema: T.StructType) -> list[T.StructField]:
    """Fields by position, so that no name clashes with that of the batch."""
    return [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)]


def _slots(events: DataFrame, key: str, at: str, quiet_seconds: float) -> str:
    """SQL over ``{events}``: one row per key and slot of the quiet time, with its burst's start.

    Events of one slot are closer than the quiet time, so they are one burst whatever their
    number: they are pre-aggregated, and the windows see at most one row per slot of elapsed time.
    """
    quiet = int(quiet_seconds * 1_000_000)
    return f"""
        SELECT k, slot, first_at, last_at, n, last_value(opening, true) OVER (PARTITION BY k ORDER BY slot) AS burst_start
        FROM (SELECT *, IF(first_at <= lag(last_at) OVER (PARTITION BY k ORDER BY slot) + {quiet}L, NULL, first_at) AS opening
              FROM (SELECT k, slot, min(micros) AS first_at, max(micros) AS last_at, count(*) AS n
                    FROM (SELECT {quoted(key)} AS k, unix_micros({quoted(at)}) AS micros, (unix_micros({quoted(at)}) - pmod(unix_micros({quoted(at)}), {quiet}L)) DIV {quiet}L AS slot FROM {{events}} WHERE {quoted(at)} IS NOT NULL)
                    GROUP BY k, slot))"""


def bursts(events: DataFrame, key: str, at: str, quiet_seconds: float = QUIET_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """Change events collapsed into bursts that end after a quiet time; batch or stream.

    Events without a time are no events. A NULL key is a key of its own. On a stream a burst appears once the watermark has passed
    its end, so the last ones wait for later events: an event of any key, later than the quiet time, closes all that are open.
    """
    timed = events.withColumn(at, F.col(quoted(at)).cast("timestamp"))
    quiet = int(quiet_seconds * 1_000_000)
    if events.isStreaming:
        window = F.session_window(quoted(at), f"{quiet} microseconds")
        return (
            timed.withWatermark(quoted(at), lateness).groupBy(quoted(key), window.alias("burst"))
            .agg(F.count(F.lit(1)).alias("events"), F.max(quoted(at)).alias("last_event"))
            .select(quoted(key), F.col("burst.start").alias("burst_start"), F.col("burst.end").alias("burst_end"), "events", "last_event")
        )
    return runtime.query(
        f"""SELECT k AS {quoted(key)}, timestamp_micros(burst_start) AS burst_start, timestamp_micros(max(last_at) + {quiet}L) AS burst_end,
                   sum(n) AS events, timestamp_micros(max(last_at)) AS last_event
            FROM ({_slots(timed, key, at, quiet_seconds)}) GROUP BY k, burst_start""",
        events=timed,
    )
