"""Number and percent text for reports, as SQL expression text."""

from __future__ import annotations

from .text import double_text

# Fixed value: significant digits of a fractional number in reports.
SIGNIFICANT_DIGITS = 6


def grouped_integer(c: str) -> str:
    """An integer with thousands separators."""
    return f"format_number({c}, 0)"


def _settled(x: str, half_up: str, exact: str, decimals: str) -> str:
    """The rounding of ``x`` by its exact binary value, where true halves go up.

    ``half_up`` rounds the printed decimal, ``exact`` the binary value but true halves to even.
    They differ only when the printed decimal is a half; it is a true one if it is a binary fraction.
    """
    scaled = f"{x} * pow(2, {decimals} + 1)"
    return f"CASE WHEN {half_up} = {exact} OR {scaled} = floor({scaled}) THEN {half_up} ELSE {exact} END"


def _exact(x: str, decimals: str) -> str:
    return f"CAST(replace(format_number({x}, {decimals}), ',', '') AS DOUBLE)"


def significant(x: str) -> str:
    """``x`` rounded to six significant digits."""
    half_up = f"CAST(format_string('%.{SIGNIFICANT_DIGITS - 1}e', {x}) AS DOUBLE)"
    decimals = f"CAST({SIGNIFICANT_DIGITS - 1} - floor(log10(abs({x}))) AS INT)"
    return f"CASE WHEN abs({x}) BETWEEN 1e-9 AND 1e6 THEN {_settled(x, half_up, _exact(x, decimals), decimals)} ELSE {half_up} END"


def number_text(x: str) -> str:
    """Integers with thousands separators, other numbers with six significant digits."""
    return (
        f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN {grouped_integer(f'CAST({x} AS BIGINT)')} "
        f"ELSE {double_text(significant(x))} END"
    )


def percent_text(p: str) -> str:
    """A percentage with at most one decimal; tiny shares print as ``<0.1``."""
    rounded = _settled(p, f"round({p}, 1)", _exact(p, "1"), "1")
    return f"CASE WHEN {p} > 0 AND {p} < 0.1 THEN '<0.1' ELSE {double_text(f'({rounded})')} END"


def delta_text(before: str, after: str) -> str:
    """``+106 rows (1,204 to 1,310)``, or ``1,310 rows as before``; NULL without a before."""
    size = f"concat(IF({after} > {before}, '+', '-'), {grouped_integer(f'abs({after} - {before})')})"
    changed = f"concat({size}, ' rows (', {grouped_integer(before)}, ' to ', {grouped_integer(after)}, ')')"
    return f"IF({after} = {before}, concat({grouped_integer(after)}, ' rows as before'), {changed})"
