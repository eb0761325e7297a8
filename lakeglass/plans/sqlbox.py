"""Read-only SQL whose result can be profiled and filtered like a table."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..operators.filters import Boxes, filter_rows
from ..operators.profile import describe_columns, profile
from ..operators.summarize import summarize
from ..operators.table import clamp_rows, shown_text
from .guard import RefusedQuery, check_statement, split_statements

GONE = "No result is kept under this id."
NOTHING = "There is no statement in this text."


@dataclass(frozen=True)
class QueryOutcome:
    """A result: its page as text, what was cut, and the id it is kept under; or an error."""

    headers: tuple[str, ...] = ()
    page: DataFrame | None = None
    shown_rows: int = 0
    kept_rows: int = 0
    truncated: bool = False
    elapsed_ms: int = 0
    result_id: int | None = None
    error: str | None = None


_RELATION = r"(?P<relation>[^\s;()]+)"
_SUMMARIZE = re.compile(rf"^summarize\s+(?:{_RELATION}|(?P<query>(?:select|with|from)\b.*))$", re.I | re.S)
_TABLE_INFO = re.compile(r"^pragma\s+table_info\s*\(\s*['\"`]?(?P<relation>[^'\"`)]+)['\"`]?\s*\)$", re.I)
_PIVOT = re.compile(
    rf"^pivot\s+{_RELATION}\s+on\s+(?P<on>[\w`.]+)\s+using\s+(?P<using>.+?)(?:\s+group\s+by\s+(?P<by>[\w`.,\s]+))?$", re.I | re.S
)


def pivot(df: DataFrame, on: str, using: str, group_by: list[str] | None = None) -> DataFrame:
    """One column per value of ``on``. Without ``group_by``, by all columns not otherwise used.

    Spark lists the pivot values first and refuses more than ``spark.sql.pivotMaxValues``.
    """
    if group_by is None:
        used = {c.strip("`").lower() for c in re.findall(r"[\w`]+", using)} | {on.strip("`").lower()}
        group_by = [c for c in df.columns if c.lower() not in used]
    return df.groupBy(*group_by).pivot(on.strip("`")).agg(F.expr(using))


def table_info(df: DataFrame) -> DataFrame:
    return describe_columns(df)


class SqlBox:
    """Runs guarded SQL and keeps the newest result, all of it, as a table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._results: dict[int, tuple[DataFrame, str]] = {}

    def statement(self, text: str) -> DataFrame:
        """One guarded statement as a DataFrame."""
        spark = self.spark
        if match := _SUMMARIZE.match(text):
            return summarize(spark.table(match["relation"]) if match["relation"] else self.statement(match["query"]))
        if match := _TABLE_INFO.match(text):
            return table_info(spark.table(match["relation"]))
        if match := _PIVOT.match(text):
            by = [c.strip() for c in match["by"].split(",")] if match["by"] else None
            # The measure is an expression of its own; the guard sees it as a query.
            check_statement(spark, f"SELECT {match['using']} FROM {match['relation']}")
            return pivot(spark.table(match["relation"]), match["on"], match["using"], by)
        check_statement(spark, text)
        return spark.sql(text)

    def query(self, text: str) -> DataFrame:
        """The last statement's result. All statements are guarded and analysed before the first runs; earlier ones then run too, for their errors."""
        statements = split_statements(text)
        if not statements:
            raise RefusedQuery(NOTHING)
        found = [self.statement(statement) for statement in statements]
        for earlier in found[:-1]:
            earlier.write.format("noop").mode("overwrite").save()
        return found[-1]

    def run(self, text: str, max_rows: int, result_id: int = 0) -> QueryOutcome:
        """Run a query and keep its whole result under ``result_id``; only the page shown is limited. Problems come back as text.

        The rows are written to the shared scratch folder once, so follow-up questions see the same rows even if executors are lost.
        An older result goes once the new one is there.
        """
        started = time.monotonic()
        try:
            found = self.query(text)
            shown_limit = clamp_rows(max_rows) or 1
            path = runtime.scratch_path(self.spark, "result")
            plain = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
            plain.write.parquet(path)
            kept = self.spark.read.schema(plain.schema).parquet(path).toDF(*found.columns)
            total = kept.count()
            for old in list(self._results):
                self.drop(old)
            self._results[result_id] = kept, path
            shown = min(total, shown_limit)
            return QueryOutcome(
                headers=tuple(found.columns), page=shown_text(kept.limit(shown)), shown_rows=shown, kept_rows=total, truncated=total > shown,
                elapsed_ms=int((time.monotonic() - started) * 1000), result_id=result_id,
            )
        except (RefusedQuery, PySparkException) as error:
            return QueryOutcome(error=str(error))

    def result(self, result_id: int) -> DataFrame:
        if result_id not in self._results:
            raise KeyError(GONE)
        return self._results[result_id][0]

    def profile(self, result_id: int, **options) -> DataFrame:
        return profile(self.result(result_id), **options)

    def filter(self, result_id: int, boxes: Boxes) -> DataFrame:
        return filter_rows(self.result(result_id), boxes)

    def drop(self, result_id: int) -> None:
        """Forget a result and delete its files; another one is left alone."""
        if result_id in self._results:
            runtime.discard(self.spark, self._results.pop(result_id)[1])


def result_facts(df: DataFrame, max_rows: int) -> DataFrame:
    """How many rows a result has, how many a page of it shows, and whether that cuts something."""
    return df.agg(F.count(F.lit(1)).alias("kept_rows")).select(
        F.least("kept_rows", F.lit(max_rows)).cast("bigint").alias("shown_rows"), "kept_rows", (F.col("kept_rows") > max_rows).alias("truncated"))
