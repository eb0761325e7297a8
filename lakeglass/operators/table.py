"""A table as text, its first rows, global row numbers, sorting and searching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import inference, kinds
from ..functions.text import display_text, is_finite, literal
from .profile import by_ordinal

def clamp_rows(max_rows: float | None) -> int | None:
    """A row limit as a whole number of at least one; None is no limit."""
    return None if max_rows is None else max(1, int(max_rows))


def shown_text(df: DataFrame, ts_style: str = "sql") -> DataFrame:
    """Every cell as the text a table shows; NULL is the empty text."""
    plain, fields = by_ordinal(df)
    return plain.selectExpr(*[f"{display_text(f.ref, f.dtype, ts_style)} AS {f.ref}" for f in fields]).toDF(*df.columns)


def head(df: DataFrame, max_rows: int | None = None, order_by: list[str | Column] | None = None) -> DataFrame:
    """The first rows as text. With ``order_by`` each task keeps only its top rows."""
    limit = clamp_rows(max_rows)
    ordered = df.orderBy(*order_by) if order_by else df
    return shown_text(ordered if limit is None else ordered.limit(limit))


def size_facts(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Exact row total, rows shown and whether rows were cut; Parquet reads no column for it."""
    limit = clamp_rows(max_rows)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    shown = F.col("total_rows") if limit is None else F.least(F.col("total_rows"), F.lit(limit).cast("bigint"))
    return total.select("total_rows", shown.alias("shown_rows"), (F.col("total_rows") > shown).alias("truncated"),
                        F.lit(len(df.columns)).alias("column_count"))


def sorted_slices(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """``df`` globally sorted and written, with ``slice`` and ``position`` inside the slice.

    A slice is one task of a range exchange. Ranges are cut by all sort columns and, last, by
    a running row id, so neither a frequent key nor equal rows pile up in one slice. The
    sorted table is written because two uses must see the same slices.
    """
    tie = "__tie"
    sized = df.withColumn(tie, F.monotonically_increasing_id())
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col(tie)]
    placed = (
        sized.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("slice", F.spark_partition_id())
        .withColumn("position", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(tie)
    )
    return runtime.materialize(placed, "sorted")


def slice_offsets(placed: DataFrame) -> DataFrame:
    """Rows before each slice: one row per slice, so the running sum is small and bounded."""
    return runtime.query(
        """SELECT slice, coalesce(sum(n) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS before
           FROM (SELECT slice, count(*) AS n FROM {placed} GROUP BY slice)""",
        placed=placed,
    )


def with_row_index(df: DataFrame, order_by: list[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in ``order_by`` order, without one big sorted task."""
    placed = sorted_slices(df, order_by)
    return (
        placed.join(F.broadcast(slice_offsets(placed)), "slice")
        .withColumn(name, F.col("before") + F.col("position"))
        .drop("slice", "position", "before")
    )


def sort_rows(df: DataFrame, column: str, tie_break: list[str], descending: bool = False) -> DataFrame:
    """Sort by one column: typed values as they are, numeric text as numbers before other text.

    Empty cells come last in both directions.
    """
    keyed, order, tie = _sort_keys(df, column, tie_break, descending)
    return keyed.orderBy(*order, *tie).drop("number", "filled", "other").toDF(*df.columns)


def sorted_with_position(df: DataFrame, column: str, tie_break: list[str], descending: bool = False, name: str = "position") -> DataFrame:
    """The rows with the place that ``sort_rows`` gives them, counted from 0, without one big sorted task."""
    keyed, order, tie = _sort_keys(df, column, tie_break, descending)
    placed = sorted_slices(keyed, [*order, *[F.col(t) for t in tie]])
    numbered = placed.join(F.broadcast(slice_offsets(placed)), "slice").withColumn("place", F.col("before") + F.col("position"))
    return numbered.select(*[c for c in keyed.columns if c not in ("number", "filled", "other")], "place").toDF(*df.columns, name)


def _sort_keys(df: DataFrame, column: str, tie_break: list[str], descending: bool) -> tuple[DataFrame, list[Column], list[str]]:
    plain, fields = by_ordinal(df)
    field = next(f for f in fields if f.name == column)
    if kinds.kind_of(field.dtype) in (kinds.INTEGER, kinds.FLOAT, kinds.DATE, kinds.BOOLEAN):
        keyed = plain.selectExpr("*", f"{field.ref} AS number", f"{field.ref} IS NOT NULL AS filled", "CAST(NULL AS STRING) AS other")
    else:
        # Lateral views evaluate the text and the number once per row.
        found = f"try_cast(regexp_extract(t, {literal(inference.PADDED_NUMBER_FORM)}, 1) AS DOUBLE)"
        keyed = runtime.query(
            f"""SELECT * EXCEPT (t, x), IF({is_finite('x')}, x, NULL) AS number, NOT ({inference.matches('t', inference.BLANK_FORM)}) AS filled,
                       IF({is_finite('x')}, NULL, t) AS other
                FROM {{df}} LATERAL VIEW inline(array(struct({display_text(field.ref, field.dtype)}))) AS t
                LATERAL VIEW inline(array(struct({found}))) AS x""",
            df=plain,
        )
    # One direction for the whole order, except that empty cells stay last.
    value = [F.col("number").isNull(), F.col("number"), F.col("other")]
    order = [~F.col("filled")] + [c.desc() if descending else c.asc() for c in value]
    names = {f.name: f.ref for f in fields}
    return keyed, order, [names[t] for t in tie_break]


def _cells_with(df: DataFrame, needle: str, row_id: str) -> DataFrame:
    plain, fields = by_ordinal(df)
    key = next(f for f in fields if f.name == row_id)
    rows = ", ".join(f"{f.ordinal}, {literal(f.name)}, {display_text(f.ref, f.dtype)}" for f in fields)
    return runtime.query(
        f"""SELECT {key.ref} AS row_id, ordinal, column, cell
            FROM {{df}} LATERAL VIEW stack({len(fields)}, {rows}) AS ordinal, column, cell
            WHERE contains(lower(cell), lower({literal(needle)}))""",
        df=plain,
    )


def find(df: DataFrame, needle: str, row_id: str, max_hits: int | None = None) -> DataFrame:
    """The cells that contain a text, ignoring case, in row and column order; all of them, or a first page."""
    found = _cells_with(df, needle, row_id).orderBy("row_id", "ordinal")
    return found if max_hits is None else found.limit(max_hits)


def find_count(df: DataFrame, needle: str, row_id: str) -> DataFrame:
    return _cells_with(df, needle, row_id).agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("row_id").alias("rows"))
