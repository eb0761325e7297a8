"""Helpers that several of the operators need."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeglass.runtime import scratch_path


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to write: its results replace them."""
    return df.drop(*names)


def written(df: DataFrame, label: str, large_rows: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared scratch folder; the table read back, and its path.

    ``large_rows``: a page of a column ends at the usual 1 MB even if it has few rows. Else sizes are looked at after 100 rows only, and a page is
    compressed, held and decompressed whole.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**{"parquet.page.size.row.check.min": 1} if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Spark gives Python batches of about ``size`` bytes, or of one row that is larger, not of its own 64 MB or 10,000 rows. Holds for what runs inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Ids up to which a list of them is broadcast, about 16 MB.
BROADCAST_IDS = 1_000_000


def rows_of(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``ids``, a table with that column alone. A short list goes to the rows, a long one is joined by shuffle."""
    listed = ids.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed, column, "left_semi")


#: A key with more than this part of all rows is hot.
HOT_PART = 200


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per key, or nulls. ``rows`` must be a written table, since it is read several times.

    Keys with more than a ``HOT_PART``-th of the rows are fewer than ``HOT_PART``, so the rows of ``table`` for them are broadcast; all
    others are joined by shuffle. Rows with a null in their key match nothing and are not shuffled.
    """
    whole = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    named = rows.where(whole)
    hot = named.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") * HOT_PART > rows.count()).select(*keys)
    unnamed = rows.where(f"NOT ({whole})").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in keys])
    if hot.isEmpty():
        return named.join(table, keys, "left").select(unnamed.columns).union(unnamed)
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)  # fewer than HOT_PART rows
    wide = named.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys, "left")
    rest = named.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left")
    return wide.select(unnamed.columns).union(rest.select(unnamed.columns)).union(unnamed)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that on texts of one byte a character."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def learns(doc_id: Column) -> Column:
    """Whether labels of a document may be learned from: its crc32 does not fall into the held-out fifth."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def crc_fold(doc_id) -> int:
    """The Python form of the fold of ``learns``; for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
