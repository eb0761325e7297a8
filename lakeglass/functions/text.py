"""Text forms of cells.

Functions here take and return Spark SQL expression text. Operators work on columns renamed to
``c0..cN``, so the names they pass need no quoting, and one parsed statement is much cheaper to
build than hundreds of separate column calls.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The characters that count as blank around a cell.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
ELLIPSIS = "…"
#: Longer texts are told apart by a digest where only their number counts.
KEY_CHARS = 64

INFINITY = "double('Infinity')"


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trim_blanks(c: str) -> str:
    """``c`` without the blanks around it; most texts start and end in plain ASCII and are kept as they are."""
    plain = f"left({c}, 1) BETWEEN '!' AND '~' AND right({c}, 1) BETWEEN '!' AND '~'"
    return f"IF({plain}, {c}, btrim({c}, {literal(BLANKS)}))"


def clip(c: str, chars: int) -> str:
    """``c`` cut to ``chars`` characters with an ellipsis when something was cut."""
    return f"CASE WHEN length({c}) > {chars} THEN concat(left({c}, {chars}), '{ELLIPSIS}') ELSE {c} END"


def is_finite(x: str) -> str:
    """Spark orders NaN above every number, so one comparison rejects NaN and infinities."""
    return f"abs({x}) < {INFINITY}"


def finite(x: str) -> str:
    return f"CASE WHEN {is_finite(x)} THEN {x} END"


def double_text(x: str, printed: str | None = None) -> str:
    """Shortest text of a floating number: ``10``, ``0.1``, ``1e-7``, ``1e+21``.

    ``printed`` is Spark's own text of the number; 32-bit floats must not get it through double.
    """
    printed = printed or f"CAST({x} AS STRING)"
    exponent = f"replace({printed}, '.0E', 'E')"
    # Common sizes come first: there Spark prints no exponent.
    return f"""CASE
        WHEN abs({x}) < 1e15 AND {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS STRING)
        WHEN abs({x}) >= 1e-3 AND abs({x}) < 1e7 THEN {printed}
        WHEN isnan({x}) THEN 'NaN'
        WHEN abs({x}) = {INFINITY} THEN IF({x} > 0, 'Infinity', '-Infinity')
        WHEN abs({x}) >= 1e21 THEN replace({exponent}, 'E', 'e+')
        WHEN abs({x}) >= 1e15 THEN CAST(try_cast({printed} AS DECIMAL(38,0)) AS STRING)
        WHEN abs({x}) < 1e-6 THEN replace({exponent}, 'E-', 'e-')
        ELSE rtrim('.', rtrim('0', CAST(try_cast({printed} AS DECIMAL(38,22)) AS STRING))) END"""


def timestamp_text(c: str, style: str = "sql") -> str:
    if style == "iso":
        return f"date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    return f"CAST({c} AS STRING)"


def value_text(c: str, dtype: T.DataType, ts_style: str = "sql") -> str:
    """Text of a cell; NULL stays NULL."""
    if isinstance(dtype, T.DoubleType):
        return double_text(c)
    if isinstance(dtype, T.FloatType):
        return double_text(f"CAST({c} AS DOUBLE)", f"CAST({c} AS STRING)")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c, ts_style)
    if isinstance(dtype, T.BinaryType):
        return f"lower(hex({c}))"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({c}, map('ignoreNullFields', 'false'))"
    return f"CAST({c} AS STRING)"


def display_text(c: str, dtype: T.DataType, ts_style: str = "sql") -> str:
    """Text of a cell as a table shows it; NULL is the empty text."""
    return f"coalesce({value_text(c, dtype, ts_style)}, '')"


def text_key(text: str) -> str:
    """A text, or the SHA-256 of a long one: equal exactly where the texts are, and short in a shuffle.

    A marked digest has 65 characters, so no text that stands for itself equals one.
    """
    return f"IF(length({text}) > {KEY_CHARS}, concat('#', sha2({text}, 256)), {text})"
