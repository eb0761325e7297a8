"""What kind of value a piece of text is, as SQL expression text."""

from __future__ import annotations

from .text import BLANKS, literal

# The forms a trimmed, non-empty text is tested against, in this order.
INTEGER_FORM = r"^[+-]?(0|[1-9]\d*)\z"
FLOAT_FORM = r"^[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
DATE_FORM = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(Z|[+-]\d{2}:?\d{2})?)?\z"
BOOLEAN_WORDS = ("true", "false")
# What a filter accepts as a number, and as a cell that starts with a day.
NUMBER_FORM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DAY_PREFIX_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]|\z)"
# The same with the blanks around a cell, and a cell of blanks alone.
BLANK_FORM = rf"^[{BLANKS}]*\z"
PADDED_NUMBER_FORM = rf"^[{BLANKS}]*({NUMBER_FORM[1:-2]})[{BLANKS}]*\z"
# Fixed value: doubles hold every integer below this.
SAFE_INTEGER = 2**53 - 1

# Parts of a text in the date form: zone offset, clock, and the clock that ends a day.
ZONE_FORM = r":\d{2}(?:\.\d+)?(Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)\z"
CLOCK_FORM = r"^.{11}([0-9:.]+)(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?\z"
END_OF_DAY_FORM = r"^24:00(:00(\.0+)?)?\z"


def whole_number_order(s: str, falling: bool = False) -> str:
    """A key that sorts whole numbers of any length by value, from their text.

    Longer numbers are larger; among negative ones the order of lengths and digits turns round.
    """
    digits = f"ltrim('+-', {s})"
    turned = f"struct({{}} AS sign, -length({digits}) AS size, translate({digits}, '0123456789', '9876543210') AS digits)"
    plain = f"struct({{}} AS sign, length({digits}) AS size, {digits} AS digits)"
    below, above = (plain.format(1), turned.format(0)) if falling else (turned.format(0), plain.format(1))
    return f"CASE WHEN {matches(s, INTEGER_FORM)} THEN IF({s} LIKE '-%', {below}, {above}) END"


def matches(c: str, form: str) -> str:
    return f"{c} RLIKE {literal(form)}"


def zone_of(s: str) -> str:
    return f"regexp_extract({s}, {literal(ZONE_FORM)}, 1)"


def clock_of(s: str) -> str:
    return f"regexp_extract({s}, {literal(CLOCK_FORM)}, 1)"


def epoch_millis(s: str, clock: str, zone: str) -> str:
    """Milliseconds of a text in the date form; NULL for an impossible day, time or offset.

    Without a zone the time is UTC. The offset is subtracted by hand, since offsets beyond 18
    hours are valid here but not for a timestamp cast; so is hour 24, which ends the day.
    """
    midnight = f"CAST(unix_date(try_cast(left({s}, 10) AS DATE)) AS BIGINT) * 86400000L"
    instant = (
        f"CASE WHEN length({s}) = 10 THEN {midnight} "
        f"WHEN {matches(clock, END_OF_DAY_FORM)} THEN {midnight} + 86400000L "
        f"ELSE unix_millis(try_cast(concat(left({s}, 10), 'T', {clock}, IF(length({clock}) = 5, ':00Z', 'Z')) AS TIMESTAMP)) END"
    )
    offset = (
        f"IF(length({zone}) < 5, 0L, IF({zone} LIKE '-%', -60000L, 60000L) * "
        f"(CAST(substr({zone}, 2, 2) AS INT) * 60 + CAST(right({zone}, 2) AS INT)))"
    )
    return f"({instant}) - {offset}"


def text_shape(s: str) -> str:
    """Kind of a trimmed, non-empty text by its form; dates still need a real instant.

    The first byte decides whether any pattern is tried.
    """
    words = ", ".join(f"'{w}'" for w in BOOLEAN_WORDS)
    return f"""CASE
        WHEN {s} IS NULL THEN NULL
        WHEN {s} >= '+' AND {s} < ':' THEN CASE
            WHEN {matches(s, INTEGER_FORM)} THEN 'integer'
            WHEN {matches(s, FLOAT_FORM)} THEN 'float'
            WHEN length({s}) >= 10 AND {matches(s, DATE_FORM)} THEN 'date'
            ELSE 'text' END
        WHEN length({s}) < 6 AND lower({s}) IN ({words}) THEN 'boolean'
        ELSE 'text' END"""


def variant_class(v: str) -> str:
    """Class of one VARIANT value by how it is stored, without its parts; NULL if there is no value."""
    return f"IF({v} IS NULL, NULL, split_part(split_part(schema_of_variant({v}), '(', 1), '<', 1))"


def variant_kind(c: str) -> str:
    """Kind of a VARIANT value by its class."""
    return f"""CASE {c}
        WHEN 'BIGINT' THEN 'integer'
        WHEN 'DECIMAL' THEN 'float' WHEN 'DOUBLE' THEN 'float' WHEN 'FLOAT' THEN 'float'
        WHEN 'STRING' THEN 'text'
        WHEN 'BOOLEAN' THEN 'boolean'
        WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'date' WHEN 'TIMESTAMP_NTZ' THEN 'date'
        WHEN 'VOID' THEN NULL
        ELSE IF({c} IS NULL, NULL, 'other') END"""
