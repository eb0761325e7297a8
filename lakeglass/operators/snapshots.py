"""Row-count changes between snapshots, and remembered profiles."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame

from .. import runtime
from ..functions.numbers import delta_text
from .profile import profile
from .table import sorted_slices


def snapshot_deltas(log: DataFrame) -> DataFrame:
    """Each ``(relation, at, rows)`` snapshot with the one before it and the change as text.

    The log is sorted into balanced slices; only the last snapshot of each slice and relation
    crosses slices, so a relation that fills the log is no single task. Snapshots of a relation at one instant follow each
    other by their rows, NULL first.
    """
    return runtime.query(
        f"""
        WITH ends AS (SELECT slice, relation, max_by(rows, position) AS rows FROM {{placed}} GROUP BY slice, relation),
        opening AS (SELECT slice, relation, lag(rows) OVER (PARTITION BY relation ORDER BY slice) AS before FROM ends),
        inside AS (SELECT *, lag(rows) OVER (PARTITION BY slice, relation ORDER BY position) AS earlier FROM {{placed}})
        SELECT relation, at, previous_rows, rows, rows - previous_rows AS delta, {delta_text('previous_rows', 'rows')} AS summary
        FROM (SELECT i.relation, i.at, i.rows, coalesce(i.earlier, o.before) AS previous_rows
              FROM inside AS i JOIN opening AS o ON o.slice = i.slice AND o.relation <=> i.relation)""",
        placed=sorted_slices(log.select("relation", "at", "rows"), ["relation", "at", "rows"]),
    )


class ProfileStore:
    """Profiles kept as tables under a folder, by relation, snapshot and options. Failures are kept too."""

    def __init__(self, spark, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join([self.folder, hashlib.sha256(repr(parts).encode()).hexdigest()])

    def get(self, relation: str, snapshot: str, df: DataFrame, **options) -> DataFrame:
        """The stored profile, or a new one that is stored; a half-written one does not count.

        A profile that failed is not tried again: its error is raised from then on.
        """
        path = self._path(relation, snapshot, *map(str, sorted(options.items())))
        if not self._is_there(path):
            if self._is_there(f"{path}-failed"):
                raise RuntimeError(self.spark.read.text(f"{path}-failed", wholetext=True).first()[0])
            try:
                profile(df, **options).coalesce(1).write.mode("overwrite").parquet(path)
            except PySparkException as error:
                text = self.spark.createDataFrame([(str(error),)], "value string")
                text.coalesce(1).write.mode("overwrite").text(f"{path}-failed")
                raise
        return self.spark.read.parquet(path).orderBy("ordinal")

    def _is_there(self, path: str) -> bool:
        try:
            return self.spark.read.text(f"{path}/_SUCCESS").limit(1) is not None
        except AnalysisException:
            return False
