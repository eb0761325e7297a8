"""The queries of this library on the shared test tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[["Tables"], DataFrame]


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """SQL over tables named in braces."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


BUILDERS: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Build, oracle: str | None = None) -> None:
    if name in BUILDERS:
        raise ValueError(f"query {name} is registered twice")
    BUILDERS[name] = build
    if oracle is not None:
        ORACLES[name] = oracle


def duck_text(c: str, kind: str) -> str:
    """DuckDB text of a cell as a table shows it."""
    if kind != "double":
        return f"coalesce(CAST({c} AS VARCHAR), '')"
    return (f"CASE WHEN {c} IS NULL THEN '' WHEN isfinite({c}) AND {c} = floor({c}) AND abs({c}) < 1e15 "
            f"THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END")
