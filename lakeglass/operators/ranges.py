"""Cell ranges: selecting, summarising and exporting rectangles of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import runtime
from ..functions import inference, kinds
from ..functions.numbers import grouped_integer, number_text
from ..functions.text import display_text, is_finite, literal, trim_blanks
from .profile import Field, by_ordinal


@dataclass(frozen=True)
class Range:
    """Rows ``r0..r1`` by ``columns c0..c1``, all inclusive; None leaves a side open."""

    r0: int | None = None
    r1: int | None = None
    c0: int | None = None
    c1: int | None = None

    @staticmethod
    def cells(a: tuple[int, int], b: tuple[int, int]) -> Range:
        """The rectangle between two ``(row, column)`` spots, in either order."""
        (r0, r1), (c0, c1) = sorted((a[0], b[0])), sorted((a[1], b[1]))
        return Range(r0, r1, c0, c1)

    @staticmethod
    def rows(a: int, b: int) -> Range:
        return Range(min(a, b), max(a, b))

    @staticmethod
    def cols(a: int, b: int) -> Range:
        return Range(None, None, min(a, b), max(a, b))

    def holds_column(self, ordinal: int) -> bool:
        return (self.c0 is None or ordinal >= self.c0) and (self.c1 is None or ordinal <= self.c1)

    def row_condition(self, row: str) -> str:
        sides = [f"{row} >= {self.r0}" if self.r0 is not None else "", f"{row} <= {self.r1}" if self.r1 is not None else ""]
        return " AND ".join(s for s in sides if s) or "true"


def _held(df: DataFrame, ranges: list[Range], row_id: str) -> tuple[DataFrame, list[tuple[Field, str]]]:
    """The table by ordinals, and the columns that any range holds with the condition on their rows."""
    data, fields = by_ordinal(df.drop(row_id))
    plain = df.select(row_id, *[c for c in df.columns if c != row_id]).toDF("row_id", *data.columns)
    chosen = [(f, [r.row_condition("row_id") for r in ranges if r.holds_column(f.ordinal)]) for f in fields]
    return plain, [(f, " OR ".join(f"({c})" for c in conditions)) for f, conditions in chosen if conditions]


def selected_cells(df: DataFrame, ranges: list[Range], row_id: str) -> DataFrame:
    """Cells of the union of ranges as ``(row_id, ordinal, cell)``; an overlap counts once.

    A cell is tested against the ranges of its column, so nothing is expanded per range and no
    de-duplication is needed. ``row_id`` numbers the rows and is not a cell itself.
    """
    plain, held = _held(df, ranges, row_id)
    if not held:
        return runtime.query("SELECT row_id, 0 AS ordinal, '' AS cell FROM {df} WHERE false", df=plain)
    rows = ", ".join(f"{f.ordinal}, IF({inside}, {display_text(f.ref, f.dtype)}, NULL)" for f, inside in held)
    return runtime.query(
        f"""SELECT row_id, ordinal, cell FROM {{df}} LATERAL VIEW stack({len(held)}, {rows}) AS ordinal, cell
            WHERE ({' OR '.join(dict.fromkeys(inside for _, inside in held))}) AND cell IS NOT NULL""",
        df=plain,
    )


def range_summary(df: DataFrame, ranges: list[Range], row_id: str) -> DataFrame:
    """Cell count, and sum, average and extremes when every non-empty cell is a finite number.

    Numeric columns are summed up as they are; only the cells of others are read as texts.
    """
    plain, held = _held(df, ranges, row_id)
    rows = []
    for f, inside in held:
        if kinds.is_numeric(f.dtype):
            filled, x = f"{f.ref} IS NOT NULL", f"CAST({f.ref} AS DOUBLE)"
        else:
            t = trim_blanks(display_text(f.ref, f.dtype))
            filled, x = f"{t} <> ''", f"IF({inference.matches(t, inference.NUMBER_FORM)}, try_cast({t} AS DOUBLE), NULL)"
        rows.append(f"{inside}, {filled}, {x}")
    cells = (f"SELECT * FROM {{df}} LATERAL VIEW stack({len(rows)}, {', '.join(rows)}) AS inside, filled, x WHERE inside" if rows
             else "SELECT false AS filled, CAST(NULL AS DOUBLE) AS x FROM {df} WHERE false")
    return runtime.query(
        f"""
        WITH typed AS (SELECT filled, IF({is_finite('x')}, x, NULL) AS x FROM ({cells})),
        facts AS (SELECT count(*) AS cells, count_if(filled) AS filled, count(x) AS numbers, sum(x) AS s, avg(x) AS a, min(x) AS lo, max(x) AS hi FROM typed)
        SELECT cells, IF(ok, s, NULL) AS sum, IF(ok, a, NULL) AS avg, IF(ok, lo, NULL) AS min, IF(ok, hi, NULL) AS max,
               CASE WHEN cells <= 1 THEN '' WHEN NOT ok THEN concat('n = ', {grouped_integer('cells')})
                    ELSE concat('n = ', {grouped_integer('cells')}, ', total ', {number_text('s')}, ', mean ', {number_text('a')},
                                ', from ', {number_text('lo')}, ' to ', {number_text('hi')}) END AS label
        FROM (SELECT *, filled = numbers AND filled > 0 AND coalesce({is_finite('s')}, false) AS ok FROM facts)""",
        df=plain,
    )


def tsv_cell(c: str) -> str:
    """A cell as a spreadsheet pastes it: quoted when it holds a tab, a line break or a quote."""
    return f"IF({c} RLIKE '[\\t\\r\\n\"]', concat('\"', replace({c}, '\"', '\"\"'), '\"'), {c})"


def tsv_lines(df: DataFrame, chosen: Range | list[Range], row_id: str, header: bool = False) -> DataFrame:
    """Ranges as ``block, row_id, line``: one block of tab-separated text per range, in the order given.

    Lines come in row order. A header stands above the first block only.
    """
    data, fields = by_ordinal(df.drop(row_id))
    plain = df.select(row_id, *[c for c in df.columns if c != row_id]).toDF("row_id", *data.columns)
    parts = []
    for block, one in enumerate(chosen if isinstance(chosen, list) else [chosen]):
        held = [f for f in fields if one.holds_column(f.ordinal)]
        cells = ", ".join(tsv_cell(display_text(f.ref, f.dtype)) for f in held) or "''"
        if header and block == 0:
            names = ", ".join(tsv_cell(literal(f.name)) for f in held) or "''"
            parts.append(f"SELECT 0 AS block, CAST(NULL AS BIGINT) AS row_id, concat_ws('\\t', {names}) AS line")
        parts.append(f"SELECT {block} AS block, CAST(row_id AS BIGINT) AS row_id, concat_ws('\\t', {cells}) AS line FROM {{df}} WHERE {one.row_condition('row_id')}")
    return runtime.query(f"SELECT * FROM ({' UNION ALL '.join(parts)}) ORDER BY block, row_id NULLS FIRST", df=plain)


__all__ = ["Range", "range_summary", "selected_cells", "tsv_cell", "tsv_lines"]
