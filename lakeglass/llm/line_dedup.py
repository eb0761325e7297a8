"""Line dedup: a suffix array over the lines of all documents by prefix doubling; later copies of repeated runs are deleted.

Lines are numbered within their document, and documents follow each other by id. A run of lines is a repeat if the same
lines stand in the same order at an earlier place. All repeats of at least ``MIN_WORDS`` words are deleted.

1. Lines that occur once anywhere end every repeat. Only stretches of lines that occur more often go on.
2. Ranks order all suffixes by their first 1, 2, 4, ... lines. Each doubling sorts the distinct pairs of two ranks by
   range over the cluster and numbers them, so suffixes of one rank are an interval of the suffix array whose common
   prefix has that length. Suffixes alone in their interval repeat nothing from there on and drop out.
3. A maximal repeat is a union of least repeats: for each line the shortest run of ``MIN_WORDS`` words that begins
   there, and the shortest that ends there. Runs of ``k`` lines are equal when they agree in ``k`` and in the ranks of
   their first and last ``2**l`` lines, ``2**l`` being the largest power up to ``k``. So one grouping finds the first
   copy of every least run, and the runs behind it are deleted. Minima combine on the map side; hot lines do not meet in one task.

Defined results: null and empty texts have no lines and stay as they are. Copies that overlap their original count as
copies. Rows that repeat a ``doc_id`` with the same text are one document and get the same result; null ids
come last. A document that loses all lines keeps an empty text. Results replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeglass.llm.shared import replacing, written

MIN_WORDS = 50
#: Changed documents up to which their list is broadcast to the texts, about 20 MB.
BROADCAST_DOCUMENTS = 200_000
KEY = ["doc_id", "print"]


def _body(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, print, line, h1, h2, words``: the print tells apart rows that share an id, the hashes stand for the line."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), _body(F.col(text)).alias("text")).where("text <> ''")
    rows = texts.select("doc_id", F.xxhash64("text", F.length("text")).alias("print"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    known = rows.select(*KEY, "line", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(2), "body", F.length("body")).alias("h2"),
                        F.regexp_count("body", F.lit(r"\S+")).alias("words"))
    return known.repartition(*KEY).dropDuplicates([*KEY, "line"])


def _numbered(distinct: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct keys with a ``rank`` in their order: sorted by range, numbered within each range."""
    ordered = distinct.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id())
    return written(ordered, label)[0]


def _least_runs(batches: Iterator[pd.DataFrame], min_words: int) -> Iterator[pd.DataFrame]:
    """``start`` and number of lines ``k`` of the least runs of every stretch."""
    for batch in batches:
        for row in batch.itertuples():
            words = np.array([x["words"] for x in row.lines], np.int64)
            first = row.lines[0]["line"]
            ends = np.cumsum(words)
            before = ends - words
            n = np.arange(len(words))
            last = np.searchsorted(ends, before + min_words)  # the line with which a run from here has enough words
            begin = np.searchsorted(before, ends - min_words, side="right") - 1
            runs = {(int(s), int(e - s + 1)) for s, e in zip(n, last) if e < len(words)} | {(int(s), int(e - s + 1)) for s, e in zip(begin, n) if s >= 0}
            if runs:
                starts, sizes = zip(*runs)
                yield pd.DataFrame({"doc_id": pd.array([row.doc_id if not pd.isna(row.doc_id) else None] * len(runs), "Int64"), "print": row.print,
                                    "start": np.array(starts) + first, "k": sizes})


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, print, start, end``: the lines to delete, as disjoint ranges without ``end``."""
    lines, _ = written(_lines(docs, doc_id, text), "lines")
    repeated = _numbered(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), ["h1", "h2"], "ranks")
    placed, _ = written(lines.join(repeated, ["h1", "h2"]).select(*KEY, "line", "words", "rank"), "level")
    numbered = placed.selectExpr(*KEY, "line", "words", "line - row_number() OVER (PARTITION BY doc_id, print ORDER BY line) AS stretch")
    stretches = numbered.groupBy(*KEY, "stretch").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("lines")).where(
        F.expr(f"aggregate(lines, 0, (s, x) -> s + x.words) >= {min_words}"))
    runs, _ = written(stretches.select(*KEY, "lines").mapInPandas(lambda b: _least_runs(b, min_words), "doc_id bigint, print bigint, start int, k int"), "runs")
    most = runs.agg(F.max("k")).first()[0] or 0
    copies = None
    level, width = placed.select(*KEY, "line", "rank"), 1
    while width <= most:
        own = runs.where(F.col("k").between(width, 2 * width - 1))
        first = level.select(F.col("doc_id").alias("d1"), F.col("print").alias("p1"), F.col("line").alias("l1"), F.col("rank").alias("r1"))
        last = level.select(F.col("doc_id").alias("d2"), F.col("print").alias("p2"), F.col("line").alias("l2"), F.col("rank").alias("r2"))
        ranked = own.join(first, F.expr("doc_id <=> d1 AND print = p1 AND start = l1")).join(
            last, F.expr(f"doc_id <=> d2 AND print = p2 AND start + k - {width} = l2")).select(*KEY, "start", "k", "r1", "r2")
        place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print", "start")
        origin = ranked.groupBy("k", "r1", "r2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = ranked.join(origin, ["k", "r1", "r2"]).where(place != F.col("origin")).select(*KEY, "start", (F.col("start") + F.col("k")).alias("end"))
        later, _ = written(later, "copies")
        copies = later if copies is None else copies.union(later)
        if 2 * width <= most:
            ahead = level.selectExpr(*KEY, "line", "rank AS r1", f"first_value(rank) OVER (PARTITION BY doc_id, print ORDER BY line RANGE BETWEEN {width} FOLLOWING AND {width} FOLLOWING) AS r2")
            pairs, _ = written(ahead.where("r2 IS NOT NULL"), "pairs")
            ranks = _numbered(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2"), ["r1", "r2"], "ranks")
            level, _ = written(pairs.join(ranks, ["r1", "r2"]).select(*KEY, "line", "rank"), "level")
        width *= 2
    if copies is None:
        return lines.select(*KEY, F.col("line").alias("start"), F.col("line").alias("end")).limit(0)
    # overlapping ranges become one
    starts = copies.distinct().selectExpr("*", "start > coalesce(max(end) OVER (PARTITION BY doc_id, print ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh")
    grouped = starts.selectExpr("*", "count_if(fresh) OVER (PARTITION BY doc_id, print ORDER BY start, end) AS number")
    return grouped.groupBy(*KEY, "number").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("number")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies removed from the text, and ``n_lines`` (before), ``n_deleted`` and ``deleted`` (ranges of line numbers)."""
    ranges = repeated_runs(docs, doc_id, text, min_words).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_ranges"))
    found, _ = written(ranges.withColumnsRenamed({"doc_id": "_doc_id", "print": "_print"}), "ranges")
    side = F.broadcast(found) if found.count() <= BROADCAST_DOCUMENTS else found
    base = replacing(docs, "n_lines", "n_deleted", "deleted")
    body = _body(F.col(text))
    joined = base.join(side, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(body, F.length(body)) == F.col("_print")), "left")
    listed = F.coalesce("_ranges", F.array().cast("array<struct<start:int,end:int>>"))
    lines = F.split(body, "\n")
    stay = F.filter(lines, lambda x, i: ~F.exists(listed, lambda r: (r["start"] <= i) & (i < r["end"])))
    return joined.withColumns({
        "n_lines": F.when(body == "", 0).otherwise(F.size(lines)).cast("bigint"),
        "n_deleted": F.aggregate(listed, F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"]),
        "deleted": F.transform(listed, lambda r: F.struct(r["start"].alias("first"), (r["end"] - 1).alias("last"))),
        text: F.when(F.col("_ranges").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n")),
    }).drop("_doc_id", "_print", "_ranges")
