"""Whole-table column profile: one output row per column.

Totals, nulls, extremes and means are one wide aggregate, so only partial results leave a task. Histograms are a second
scan of the numeric columns. Only exact distinct counts need the values: they become ``(ordinal, value)`` rows,
grouped on the map side, so that a frequent value costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..functions import inference, kinds
from ..functions.numbers import grouped_integer, percent_text
from ..functions.text import clip, display_text, double_text, finite, is_finite, literal, text_key, trim_blanks, value_text
from . import histogram as hist


@dataclass(frozen=True)
class Field:
    """A column by position: names may repeat or hold any character."""

    ordinal: int
    name: str
    dtype: T.DataType

    @property
    def ref(self) -> str:
        return f"c{self.ordinal}"


def by_ordinal(df: DataFrame) -> tuple[DataFrame, list[Field]]:
    """``df`` with its columns renamed to ``c0..cN``, and the fields that describe them."""
    fields = [Field(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]
    return df.toDF(*[f.ref for f in fields]), fields


def describe_columns(df: DataFrame) -> DataFrame:
    """Column list with kinds and native types, from the schema alone."""
    _, fields = by_ordinal(df)
    rows = ", ".join(
        f"({f.ordinal}, {literal(f.name)}, '{kinds.kind_of(f.dtype)}', {literal(kinds.native_type(f.dtype))})"
        for f in fields
    )
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(ordinal, column, kind, native_type)")


def _ordinals(fields: list[Field], test: Callable[[Field], bool]) -> str:
    """SQL condition: the row's column is one of the fields that pass ``test``."""
    chosen = [str(f.ordinal) for f in fields if test(f)]
    return f"ordinal IN ({', '.join(chosen)})" if chosen else "false"


def scan_groups(fields: list[Field]) -> list[list[Field]]:
    """Cut fields into the groups one scan takes, so that no aggregate gets too wide to compile."""
    return [fields[i:i + runtime.COLUMNS_PER_SCAN] for i in range(0, len(fields), runtime.COLUMNS_PER_SCAN)]


# --- typed tables --------------------------------------------------------------------------

_AS_LONG = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)
#: Doubles below this are told apart by their hundredths if they have no finer part.
_HUNDREDTHS_BELOW = "1e13D"
_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _family(f: Field) -> str:
    """Columns of one family share the type by which their values are told apart."""
    if isinstance(f.dtype, _AS_LONG):
        return "bigint"
    if isinstance(f.dtype, (T.FloatType, T.DoubleType)):
        return "double"
    return f.dtype.simpleString() if isinstance(f.dtype, T.DecimalType) else "string"


def _key(f: Field) -> str:
    """The value of a cell as its family's type."""
    family = _family(f)
    if isinstance(f.dtype, T.DateType):
        return f"CAST(unix_date({f.ref}) AS BIGINT)"
    if isinstance(f.dtype, T.TimestampType):
        return f"unix_micros({f.ref})"
    if isinstance(f.dtype, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, {_NTZ_EPOCH}, {f.ref})"
    return text_key(f"CAST({f.ref} AS STRING)") if family == "string" else f"CAST({f.ref} AS {family})"


def _is_summarised(f: Field) -> bool:
    return kinds.kind_of(f.dtype) not in (kinds.OTHER, kinds.EMPTY)


def _totals(df: DataFrame, fields: list[Field], ts_style: str) -> str:
    """``ordinal, rows, nulls, min, max, mean, lo, hi`` from one ungrouped aggregate a scan: only partial results are shuffled."""
    parts = []
    for group in scan_groups(fields):
        aggregates, rows = ["count(*) AS total"], []
        for f in group:
            i, kind = f.ordinal, kinds.kind_of(f.dtype)
            number = finite(f.ref) if _family(f) == "double" else f.ref
            aggregates.append(f"count({f.ref}) AS k{i}")
            low = high = "CAST(NULL AS STRING)"
            lo = hi = mean = "CAST(NULL AS DOUBLE)"
            if kind in (kinds.INTEGER, kinds.FLOAT, kinds.DATE, kinds.TEXT):
                aggregates += [f"min({number}) AS a{i}", f"max({number}) AS z{i}"]
                low, high = (value_text(x, f.dtype, ts_style) for x in (f"a{i}", f"z{i}"))
            if kinds.is_numeric(f.dtype):
                aggregates += [f"avg(CAST({number} AS DOUBLE)) AS m{i}"]
                lo, hi, mean = f"CAST(a{i} AS DOUBLE)", f"CAST(z{i} AS DOUBLE)", finite(f"m{i}")
            rows.append(f"{i}, total, total - k{i}, {low}, {high}, {mean}, {lo}, {hi}")
        parts.append(f"""SELECT stack({len(group)}, {', '.join(rows)}) AS (ordinal, rows, nulls, min, max, mean, lo, hi)
                         FROM (SELECT {', '.join(aggregates)} FROM {{df}})""")
    return " UNION ALL ".join(parts)


def _distinct(fields: list[Field]) -> str:
    """``ordinal, d``: exact counts. Values become rows of one scan a family, and are told apart on the map side before they are shuffled.

    Whole numbers, days and times travel as bitmaps: one word of 64 bits stands for 64 neighbouring values, so keys that are
    dense take a small part of the rows they would take as values, and no column takes more rows than it has values. So do
    doubles that are the nearest to a number of hundredths, such as prices; other doubles travel as values.
    """
    families: dict[str, list[Field]] = {}
    for f in filter(_is_summarised, fields):
        families.setdefault(_family(f), []).append(f)
    parts = []
    for family, members in families.items():
        for group in scan_groups(members):
            stack = ", ".join(f"{f.ordinal}, {_key(f)}" for f in group)
            cells = f"(SELECT stack({len(group)}, {stack}) AS (ordinal, v) FROM {{df}}) WHERE v IS NOT NULL"
            if family == "bigint":
                words = f"SELECT ordinal, bit_or(shiftleft(1L, CAST(v & 63L AS INT))) AS bits FROM {cells} GROUP BY ordinal, shiftright(v, 6)"
                parts.append(f"SELECT ordinal, sum(bit_count(bits)) AS d FROM ({words}) GROUP BY ordinal")
            elif family == "double":
                hundredths = f"SELECT ordinal, v, IF(abs(v) < {_HUNDREDTHS_BELOW}, CAST(rint(v * 100D) AS BIGINT), NULL) AS h FROM {cells}"
                placed = f"SELECT ordinal, IF(h / 100D = v, NULL, v) AS v, IF(h / 100D = v, h, NULL) AS h FROM ({hundredths})"
                words = f"""SELECT ordinal, bit_or(IF(h IS NULL, 1L, shiftleft(1L, CAST(h & 63L AS INT)))) AS bits
                            FROM ({placed}) GROUP BY ordinal, shiftright(h, 6), v"""
                parts.append(f"SELECT ordinal, sum(bit_count(bits)) AS d FROM ({words}) GROUP BY ordinal")
            else:
                parts.append(f"SELECT ordinal, count(*) AS d FROM (SELECT ordinal, v FROM {cells} GROUP BY ordinal, v) GROUP BY ordinal")
    return f"SELECT ordinal, sum(d) AS d FROM ({' UNION ALL '.join(parts)}) GROUP BY ordinal" if parts else "SELECT 0 AS ordinal, 0L AS d WHERE false"


def _estimates(fields: list[Field]) -> str:
    """``ordinal, d``: estimated distinct counts. The sketches have an aggregate of their own: next to the totals it would be too wide to compile."""
    parts = []
    for group in scan_groups([f for f in fields if _is_summarised(f)]):
        stack = ", ".join(f"{f.ordinal}, d{f.ordinal}" for f in group)
        aggregates = ", ".join(f"approx_count_distinct({f.ref}) AS d{f.ordinal}" for f in group)
        parts.append(f"SELECT stack({len(group)}, {stack}) AS (ordinal, d) FROM (SELECT {aggregates} FROM {{df}})")
    return " UNION ALL ".join(parts) or "SELECT 0 AS ordinal, 0L AS d WHERE false"


def _numbers(fields: list[Field]) -> str:
    """Numeric cells as rows ``ordinal, n, x``."""
    parts = []
    for group in scan_groups([f for f in fields if kinds.is_numeric(f.dtype)]):
        stack = ", ".join(f"{f.ordinal}, CAST({f.ref} AS DOUBLE)" for f in group)
        parts.append(f"SELECT stack({len(group)}, {stack}) AS (ordinal, x), 1L AS n FROM {{df}}")
    return " UNION ALL ".join(parts) or "SELECT 0 AS ordinal, CAST(NULL AS DOUBLE) AS x, 1L AS n WHERE false"


def profile(df: DataFrame, *, bins: int = hist.BINS, distinct: str = "exact", ts_style: str = "sql") -> DataFrame:
    """Profile every column of ``df`` over all of its rows.

    One scan gives all totals and extremes, one more the histograms, whose layout follows from them. ``distinct`` is
    ``"exact"``, which needs the values themselves, or ``"approx"``, which makes a sketch per column and shuffles no values.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be 'exact' or 'approx'")
    plain, fields = by_ordinal(df)
    exact = distinct == "exact"
    integers = _ordinals(fields, lambda f: kinds.kind_of(f.dtype) == kinds.INTEGER)
    ranges = f"SELECT ordinal, {integers} AS is_integer, lo, hi FROM totals WHERE lo IS NOT NULL"
    stats = runtime.query(
        f"""
        WITH totals AS ({_totals(plain, fields, ts_style)}), distincts AS ({_distinct(fields) if exact else _estimates(fields)}),
        layout AS ({hist.layout_sql(ranges, bins)}),
        histograms AS ({hist.histograms_sql(f"({_numbers(fields)})", 'x', 'layout', bins)})
        SELECT /*+ BROADCAST(histograms), BROADCAST(distincts) */ ordinal, rows, nulls, coalesce(d, 0L) AS `distinct`,
               min, max, mean, histogram, CAST(NULL AS STRING) AS found_kind
        FROM totals LEFT JOIN distincts USING (ordinal) LEFT JOIN histograms USING (ordinal)""",
        df=plain,
    )
    return _finish(describe_columns(df), stats)


# --- tables whose kinds come from the values -------------------------------------------------


def _profile_tagged(df: DataFrame, bins: int, stored: bool = False) -> DataFrame:
    """Profile of text columns, or of VARIANT columns if their kinds are those ``stored`` with the values.

    Whole texts are classified and turned into numbers and instants before anything is grouped. Grouped are spellings of numbers,
    days and truth values, and digests of long texts. Extremes of texts come from an ungrouped aggregate of their own, which
    need not classify anything: they are shown of columns that hold texts alone.
    """
    scans, text_parts = [], []
    plain, fields = by_ordinal(df)
    for group in scan_groups(fields):
        n = len(group)
        if stored:
            # The class of a value is found once; what it means is read from the class.
            rows = ", ".join(f"{f.ordinal}, {f.ref}" for f in group)
            cells = f"""SELECT ordinal, IF(shape = 'other', NULL, CAST(v AS STRING)) AS s, shape
                        FROM (SELECT stack({n}, {rows}) AS (ordinal, v) FROM {{df}})
                        LATERAL VIEW inline(array(struct({inference.variant_class('v')}))) AS class
                        LATERAL VIEW inline(array(struct({inference.variant_kind('class')}))) AS shape"""
            whole = {f: f"t{f.ordinal}" for f in group}
            found = ", ".join(inference.variant_class(f.ref) for f in group)
            shown = ", ".join(f"IF(k{f.ordinal} = 'STRING', CAST({f.ref} AS STRING), NULL) AS t{f.ordinal}" for f in group)
            source = f"(SELECT {shown} FROM {{df}} LATERAL VIEW inline(array(struct({found}))) AS {', '.join(f'k{f.ordinal}' for f in group)})"
        else:
            rows = ", ".join(f"{f.ordinal}, {display_text(f.ref, f.dtype)}" for f in group)
            cells = f"""SELECT ordinal, s, {inference.text_shape('s')} AS shape
                        FROM (SELECT ordinal, nullif({trim_blanks('raw')}, '') AS s FROM (SELECT stack({n}, {rows}) AS (ordinal, raw) FROM {{df}}))"""
            whole = {f: f"nullif({trim_blanks(f't{f.ordinal}')}, '')" for f in group}
            source = "(SELECT " + ", ".join(f"{display_text(f.ref, f.dtype)} AS t{f.ordinal}" for f in group) + " FROM {df})"
        scans.append(cells)
        aggregates = ", ".join(f"min({t}) AS a{f.ordinal}, max({t}) AS z{f.ordinal}" for f, t in whole.items())
        pairs = ", ".join(f"{f.ordinal}, a{f.ordinal}, z{f.ordinal}" for f in group)
        text_parts.append(f"SELECT stack({n}, {pairs}) AS (ordinal, a, z) FROM (SELECT {aggregates} FROM {source})")
    # Each LATERAL VIEW evaluates its expressions once, where a plain projection would be copied
    # into every condition that reads it.
    typed = f"""
        SELECT ordinal, IF(kind = 'text', {text_key('s')}, s) AS s, ms, kind, x FROM ({" UNION ALL ".join(scans)})
        LATERAL VIEW inline(array(struct(IF(shape = 'date', {inference.clock_of('s')}, NULL),
                                         IF(shape = 'date', {inference.zone_of('s')}, NULL)))) AS clock, zone
        LATERAL VIEW inline(array(struct(IF(shape = 'date', {inference.epoch_millis('s', 'clock', 'zone')}, NULL)))) AS ms
        LATERAL VIEW inline(array(struct(IF(shape = 'date' AND ms IS NULL, 'text', shape),
                                         IF(shape IN ('integer', 'float'), try_cast(s AS DOUBLE), NULL)))) AS kind, x"""
    # ``n > 0`` keeps the counts in every use of the cells, so that all uses share one exchange.
    values = f"SELECT * FROM (SELECT *, count(*) AS n FROM ({typed}) GROUP BY ALL) WHERE n > 0"
    # Numbers are one value per number, days and times one per instant; whole numbers a double
    # cannot hold are told apart by their text.
    unsafe = f"(abs(x) > {inference.SAFE_INTEGER}D AND {is_finite('x')})"  # doubles of that size are whole
    keys = f"""
        SELECT ordinal, count(*) AS d FROM (
            SELECT ordinal, IF({unsafe}, NULL, x) AS x, ms,
                   CASE WHEN kind = 'boolean' THEN lower(s) WHEN {unsafe} THEN s END AS s
            FROM cells WHERE kind IN ('integer', 'float', 'date', 'boolean') GROUP BY ALL)
        GROUP BY ordinal"""
    finite_x = finite("x")
    per_kind = ", ".join(
        f"sum(IF(kind = '{kind}', n, 0L)) AS {kind}s" for kind in ("integer", "float", "boolean", "date", "text", "other")
    )
    totals = f"""
        SELECT ordinal, sum(n) AS rows, sum(IF(kind IS NULL, n, 0L)) AS nulls, {per_kind}, count_if(kind = 'text') AS spellings,
               min({finite_x}) AS lo, max({finite_x}) AS hi, min(ms) AS early, max(ms) AS late,
               try_divide(sum({finite_x} * n), sum(IF({finite_x} IS NULL, 0L, n))) AS mean
        FROM cells GROUP BY ordinal"""
    groups = " + ".join(f"CAST({g} > 0 AS INT)" for g in ("integers + floats", "booleans", "dates", "texts", "others"))
    resolved = f"""
        SELECT *, CASE WHEN {groups} = 0 THEN NULL WHEN {groups} > 1 THEN 'mixed' WHEN floats > 0 THEN 'float'
                       WHEN integers > 0 THEN 'integer' WHEN booleans > 0 THEN 'boolean' WHEN dates > 0 THEN 'date'
                       WHEN texts > 0 THEN 'text' ELSE 'other' END AS kind FROM totals"""
    # The original spelling of each extreme: exact integers first, then the alphabetical order.
    spelled = f"struct({inference.whole_number_order('s')} AS exact, s)"
    negated = f"struct({inference.whole_number_order('s', falling=True)} AS exact, s)"
    extremes = f"""
        SELECT /*+ BROADCAST(r) */ v.ordinal, min(IF(x = lo, {spelled}, NULL)).s AS low, min(IF(x = hi, {negated}, NULL)).s AS high,
               min(IF(ms = early, s, NULL)) AS first, min(IF(ms = late, s, NULL)) AS last
        FROM cells AS v JOIN resolved AS r ON v.ordinal = r.ordinal
        WHERE r.kind IN ('integer', 'float', 'date') AND (x = lo OR x = hi OR ms = early OR ms = late)
        GROUP BY v.ordinal"""
    texts = " UNION ALL ".join(text_parts)
    ranges = "SELECT ordinal, kind = 'integer' AS is_integer, lo, hi FROM resolved WHERE kind IN ('integer', 'float')"
    low, high = (f"IF(kind = 'float', {double_text(x)}, {c})" if stored else c for c, x in (("low", "lo"), ("high", "hi")))
    stats = runtime.query(
        f"""
        WITH cells AS ({values}), keys AS ({keys}), totals AS ({totals}), resolved AS ({resolved}),
            extremes AS ({extremes}), texts AS ({texts}), layout AS ({hist.layout_sql(ranges, bins)}),
            histograms AS ({hist.histograms_sql('cells', 'x', 'layout', bins)})
        SELECT /*+ BROADCAST(keys), BROADCAST(extremes), BROADCAST(texts), BROADCAST(histograms) */
               ordinal, rows, nulls, spellings + coalesce(d, 0L) AS `distinct`,
               CASE kind WHEN 'text' THEN a WHEN 'date' THEN first ELSE {low} END AS min,
               CASE kind WHEN 'text' THEN z WHEN 'date' THEN last ELSE {high} END AS max,
               {finite('mean')} AS mean, histogram, kind AS found_kind
        FROM resolved LEFT JOIN keys USING (ordinal) LEFT JOIN extremes USING (ordinal)
             LEFT JOIN texts USING (ordinal) LEFT JOIN histograms USING (ordinal)""",
        df=plain,
    )
    columns = describe_columns(df).withColumn("kind", F.lit(kinds.EMPTY))
    return _finish(columns, stats)


def profile_text(df: DataFrame, *, bins: int = hist.BINS) -> DataFrame:
    """Profile a table of text cells, such as a CSV read without types.

    Cells are trimmed, blank ones are null, and the rest is taken for integers, floats, dates,
    booleans or text by its form. Typed columns are profiled by the text they show. Equal
    extremes show the alphabetically first of their spellings.
    """
    return _profile_tagged(df, bins)


def profile_variant(df: DataFrame, *, bins: int = hist.BINS) -> DataFrame:
    """Profile dynamically typed columns by how each VARIANT value is stored."""
    return _profile_tagged(df, bins, stored=True)


# --- from statistics to the profile ---------------------------------------------------------


def _finish(columns: DataFrame, stats: DataFrame) -> DataFrame:
    """Join statistics to the column list; a table without rows still lists its columns.

    Both sides have one row per column.
    """
    return runtime.query(
        """
        WITH joined AS (
            SELECT /*+ BROADCAST(s) */ c.ordinal, column, coalesce(found_kind, kind) AS kind, native_type,
                   coalesce(rows, 0L) AS rows, coalesce(nulls, 0L) AS nulls, coalesce(`distinct`, 0L) AS d,
                   min, max, mean, histogram
            FROM {columns} AS c LEFT JOIN {stats} AS s ON c.ordinal = s.ordinal)
        SELECT /*+ COALESCE(1) */ ordinal, column, kind, native_type, rows, nulls, IF(kind = 'other', NULL, d) AS `distinct`,
               IF(kind IN ('integer', 'float', 'date', 'text'), min, NULL) AS min,
               IF(kind IN ('integer', 'float', 'date', 'text'), max, NULL) AS max,
               IF(kind IN ('integer', 'float'), mean, NULL) AS mean,
               IF(kind IN ('integer', 'float'), histogram, NULL) AS histogram
        FROM joined SORT BY ordinal""",
        columns=columns, stats=stats,
    )


def report(profile_df: DataFrame, text_chars: int | None = None) -> DataFrame:
    """A profile with the derived facts a report shows: shares, ratios, tags and ranges.

    ``text_chars`` shortens shown extremes; without it they stay whole.
    """
    null_percent = "IF(rows > 0, 100D * nulls / rows, 0D)"
    shown = profile_df if text_chars is None else profile_df.withColumns({c: F.expr(clip(c, text_chars)) for c in ("min", "max")})
    return shown.selectExpr("*", f"{null_percent} AS __percent").selectExpr(
        "* EXCEPT (__percent)", "rows - nulls AS non_null",
        f"IF(nulls > 0, concat({grouped_integer('nulls')}, ' (', {percent_text('__percent')}, '%)'), '0') AS nulls_text",
        f"IF(`distinct` IS NULL, '—', {grouped_integer('`distinct`')}) AS distinct_text",
        "IF(rows > nulls, least(1D, `distinct` / (rows - nulls)), NULL) AS distinct_ratio",
        "CASE WHEN rows - nulls <= 1 THEN NULL WHEN `distinct` = 1 THEN 'constant' WHEN `distinct` = rows - nulls THEN 'unique' END AS tag",
        "IF(kind = 'date', concat(min, ' → ', max), NULL) AS date_range",
    )
