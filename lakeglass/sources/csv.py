"""CSV text as tables: delimiter detection, all-text scans and scans with detected types.

A file is read in splits even where quoted cells hold line breaks. A line begins a record only if it does not begin
inside a cell, which depends on all lines before it. Each line, and so each split, is a function from "outside" or "inside" to the state behind it: it
keeps the state, swaps it, or sets it. The functions of the lines of a split are composed by running windows, those of
the splits, one row each, by another window. So every split learns in which state it begins, and only cells that cross
the edge of a split are put together from two places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import runtime
from ..functions.text import literal

# Delimiters that are tried.
DELIMITERS = (",", "\t", "|", ";")
#: Types tried for the cells of a column, in this order; text fits all.
TYPES = ("int", "bigint", "double", "date", "timestamp", "boolean")


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _evidence(spark: SparkSession, path: str) -> DataFrame:
    """One row per file from one pass: its likeliest delimiter, and whether some line has an odd number of quotes."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("value <> ''")
    plain = F.regexp_replace("value", '"[^"]*"', "")
    counts = [(F.length(plain) - F.length(F.replace(plain, F.lit(d), F.lit("")))).cast("double").alias(f"n{i}") for i, d in enumerate(DELIMITERS)]
    rows = lines.select("file", *counts, (_quotes(F.col("value")) % 2 == 1).alias("odd"))
    sums = rows.groupBy("file").agg(*[f(f"n{i}").alias(f"{name}{i}") for i in range(len(DELIMITERS)) for name, f in (("mean", F.avg), ("spread", F.var_pop))],
                                    F.bool_or("odd").alias("line_breaks"))
    tried = F.array(*[F.struct(F.try_divide(F.col(f"spread{i}"), F.col(f"mean{i}")).alias("spread"), (-F.col(f"mean{i}")).alias("fields"), F.lit(i).alias("rank"), F.lit(d).alias("delimiter"))
                      for i, d in enumerate(DELIMITERS)])
    found = F.array_min(F.filter(tried, lambda t: t["fields"] < 0))
    return sums.select("file", found["delimiter"].alias("delimiter"), "line_breaks")


def sniff_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """The delimiter of every file: the one whose count per line varies least for its mean, then is highest.

    All lines of a file count, without their quoted parts. Counts are added up with their squares, so a few odd lines among
    many do not decide, and files of any size take one pass.
    """
    return _evidence(spark, path).select("file", "delimiter").where("delimiter IS NOT NULL")


def has_line_breaks_in_cells(spark: SparkSession, path: str) -> bool:
    """True when some line has an odd number of quotes, so a quoted cell may span lines."""
    return not spark.read.text(path).where(_quotes(F.col("value")) % 2 == 1).isEmpty()


def _known(spark: SparkSession, path: str, delimiter: str | None, line_breaks: bool) -> str:
    """The delimiter to read with; all evidence about the files takes one pass, and none if nothing is asked."""
    if delimiter and line_breaks:
        return delimiter
    found = _evidence(spark, path).groupBy("delimiter").agg(F.bool_or("line_breaks").alias("line_breaks")).collect()  # five rows at most
    if not line_breaks and any(r.line_breaks for r in found):
        raise ValueError(f"quoted cells under {path} span lines; read such files with line_breaks=True")
    names = sorted(r.delimiter for r in found if r.delimiter)
    if not delimiter and len(names) > 1:
        raise ValueError(f"files under {path} use different delimiters; read them one by one")
    return delimiter or (names[0] if names else ",")


def _options(delimiter: str) -> dict:
    return {"sep": delimiter, "header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns by their trimmed names; repeated names are numbered."""
    seen: dict[str, int] = {}
    out = []
    for name in (c.strip() for c in names):
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        out.append(f"{name}_{repeat}" if repeat else name)
    return df.toDF(*out)


def _line_end(spark: SparkSession, path: str) -> str:
    """What ends a line: a line feed, or a carriage return in files that have no line feed in their first line."""
    first = spark.read.text(path, lineSep="\n").select(F.substring("value", 1, 1 << 16).alias("value")).where("value <> ''").take(2)
    return "\r" if len(first) == 1 and "\r" in first[0].value[:-1] else "\n"


def _composed(order: str) -> str:
    """SQL of the state before a row as ``(coalesce(fixed, first state) + flips) % 2``, for rows with ``swap``, ``sets`` (or null) and ``flipped``, the running count of swaps."""
    before = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""last_value(IF(sets IS NULL, NULL, struct(sets, flipped)), true) {before} AS last_set,
               coalesce(max(flipped) {before}, 0L) AS flips_before"""


def _chain(df: DataFrame, *steps: str) -> DataFrame:
    """SELECTs one after the other, each from ``{x}``, the one before."""
    for step in steps:
        df = runtime.query(step, x=df)
    return df


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``file, head, text``: every record of the files, cells with line breaks included, and whether it is the first of its file.

    Empty lines outside cells are no records. The lines are shuffled once, by split.
    """
    end = _line_end(spark, path)
    lines = spark.read.text(path, lineSep=end).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # 2: a cell may begin here or its quote is doubled, 1: inside a quoted cell, 0: in an unquoted one. A quote follows each part but the last.
    walk = f"""aggregate(slice(split(value, '"', -1), 1, size(split(value, '"', -1)) - 1), {{first}},
                         (s, part) -> CASE WHEN s = 1 THEN 2 WHEN (s = 2 AND part = '') OR endswith(part, {literal(delimiter)}) THEN 1 ELSE 0 END) = 1"""
    quoted = "contains(value, '\"')"
    placed = _chain(
        lines,
        f"""SELECT *, IF({quoted}, {walk.format(first=2)}, false) AS from_outside, IF({quoted}, {walk.format(first=1)}, true) AS from_inside,
                   value IN ('', '\\r') AS blank FROM {{x}}""",
        """SELECT * EXCEPT (from_outside, from_inside), CASE WHEN from_outside = from_inside THEN CAST(from_outside AS INT) END AS sets,
                  from_outside AND NOT from_inside AS swap FROM {x}""",
        "SELECT *, count_if(swap) OVER (PARTITION BY file, block ORDER BY id ROWS UNBOUNDED PRECEDING) AS flipped FROM {x}",
        f"SELECT *, {_composed('PARTITION BY file, block ORDER BY id')} FROM {{x}}",
        "SELECT file, block, id, value, blank, swap, sets, last_set.sets AS fixed, flips_before - coalesce(last_set.flipped, 0L) AS flips FROM {x}")
    # one row per split: what it does to the state, and how many records begin in it after either state
    splits = _chain(
        placed,
        """SELECT file, block, max_by(struct(sets, swap, fixed, flips), id) AS last, count_if(NOT blank AND (coalesce(fixed, 0) + flips) % 2 = 0) AS n_outside,
                  count_if(NOT blank AND (coalesce(fixed, 1) + flips) % 2 = 0) AS n_inside FROM {x} GROUP BY file, block""",
        """SELECT file, block, n_outside, n_inside, coalesce(last.sets, (last.fixed + last.flips + CAST(last.swap AS INT)) % 2) AS sets,
                  last.sets IS NULL AND last.fixed IS NULL AND (last.flips + CAST(last.swap AS INT)) % 2 = 1 AS swap FROM {x}""",
        "SELECT *, count_if(swap) OVER (PARTITION BY file ORDER BY block ROWS UNBOUNDED PRECEDING) AS flipped FROM {x}",
        f"SELECT *, {_composed('PARTITION BY file ORDER BY block')} FROM {{x}}",
        """SELECT file, block, n_outside, n_inside, CAST((coalesce(last_set.sets, 0) + flips_before - coalesce(last_set.flipped, 0L)) % 2 AS INT) AS inside FROM {x}""",
        "SELECT file, block, inside, IF(inside = 1, n_inside, n_outside) AS n FROM {x}",
        """SELECT file, block, inside, n, last_value(IF(n > 0, struct(block, n), NULL), true) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner,
                  coalesce(lead(inside) OVER (PARTITION BY file ORDER BY block), 0) AS goes_on FROM {x}""")
    # a split may go on for several splits; the pieces of the cells that cross edges meet by the split in which the record begins
    known = runtime.query(
        """SELECT p.file, p.block, id, value, blank, (coalesce(fixed, s.inside) + flips) % 2 = 1 AS inside, n, owner, goes_on
           FROM {placed} AS p JOIN {splits} AS s ON p.file = s.file AND p.block = s.block""", placed=placed, splits=splits)
    pieces = _chain(
        known,
        "SELECT *, count_if(NOT inside AND NOT blank) OVER (PARTITION BY file, block ORDER BY id ROWS UNBOUNDED PRECEDING) AS rec FROM {x}",
        f"""SELECT file, block, rec, any_value(n) AS n, any_value(owner) AS owner, max(goes_on) AS goes_on, rec = 1 AND any_value(owner) IS NULL AS head,
                   array_join(transform(array_sort(collect_list(struct(id, value))), x -> x.value), {literal(end)}) AS text
            FROM {{x}} WHERE inside OR NOT blank GROUP BY file, block, rec""")
    whole = runtime.query(
        f"""
        SELECT file, head, text FROM {{pieces}} WHERE rec > 0 AND NOT (rec = n AND goes_on = 1)
        UNION ALL
        SELECT file, bool_or(head) AS head, array_join(transform(array_sort(collect_list(struct(block, text))), x -> x.text), {literal(end)}) AS text
        FROM (SELECT file, block, text, head, IF(rec = 0, owner, struct(block, n)) AS home FROM {{pieces}} WHERE rec = 0 OR (rec = n AND goes_on = 1)) GROUP BY file, home""",
        pieces=pieces)
    return whole.withColumn("text", F.regexp_replace("text", "\r$", "")) if end == "\n" else whole


def _split_cells(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """All cells as text, null where a row is short; the first record of each file names the columns."""
    found = records(spark, path, delimiter)
    first = found.where("head").orderBy("file").first()
    one = {**_options(delimiter), "header": False, "multiLine": True, "maxCharsPerColumn": -1, "columnPruning": False}
    width = spark.createDataFrame([(first.text.lstrip("\ufeff"),)], "text string")
    names = _cells(width, delimiter, 1 + first.text.count(delimiter), one).first()
    names = [n if n is not None else "" for n in names[:max((i + 1 for i, n in enumerate(names) if n is not None), default=1)]]
    return _named(_cells(found.where("NOT head"), delimiter, len(names), one), names)


def _cells(rows: DataFrame, delimiter: str, width: int, options: dict) -> DataFrame:
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    return rows.select(F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("row")).select("row.*")


def _fits(cell: Column, kind: str) -> Column:
    """Whether a cell reads as a type; a cast to DATE would drop a time of day."""
    return cell.try_cast(kind).isNotNull() & (~cell.contains(":") if kind == "date" else F.lit(True))


def _typed(df: DataFrame) -> DataFrame:
    """Columns of text cast to the first of ``TYPES`` that all their cells fit; one pass decides all columns."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    fits = plain.agg(*[F.struct(*[F.coalesce(F.bool_and(F.col(n).isNull() | _fits(F.col(n), t)), F.lit(False)).alias(t) for t in TYPES],
                                F.count(n).alias("cells")).alias(n) for n in names]).first()
    chosen = [next((t for t in TYPES if fits[n][t] and fits[n]["cells"]), "string") for n in names]
    return plain.select(*[F.col(n).cast(t) for n, t in zip(names, chosen)]).toDF(*df.columns)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, line_breaks: bool = False) -> DataFrame:
    """All cells as text: short rows are filled with empty cells, extra fields are dropped.

    Files are split over tasks line by line. Where quoted cells hold line breaks that would be wrong: this is an error
    unless ``line_breaks`` asks for putting such cells together, which shuffles the lines once.
    """
    if spark.read.text(path).where(F.trim("value") != "").isEmpty():
        return spark.createDataFrame([], "struct<>")
    delimiter = _known(spark, path, delimiter, line_breaks)
    if line_breaks:
        return _split_cells(spark, path, delimiter).na.fill("")
    raw = spark.read.options(**_options(delimiter), inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return _named(raw, raw.columns).na.fill("")


def read_csv_typed(spark: SparkSession, path: str, delimiter: str | None = None, line_breaks: bool = False) -> DataFrame:
    """Cells with types detected from the data, which takes one more scan."""
    delimiter = _known(spark, path, delimiter, line_breaks)
    if line_breaks:
        return _typed(_split_cells(spark, path, delimiter))
    raw = spark.read.options(**_options(delimiter), inferSchema=True).csv(path)
    return _named(raw, raw.columns)
