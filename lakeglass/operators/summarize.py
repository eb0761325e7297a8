"""SUMMARIZE: one row per column with extremes, quartiles, spread and null share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import runtime
from ..functions import kinds
from ..functions.text import literal
from .profile import by_ordinal


def summarize(df: DataFrame) -> DataFrame:
    """Min, max, estimated distinct count, average, deviation, quartiles, count and null percent.

    One aggregate per scan of 40 columns; estimates keep every state small and mergeable.
    """
    plain, fields = by_ordinal(df)
    parts = []
    for start in range(0, len(fields), runtime.COLUMNS_PER_SCAN):
        group = fields[start:start + runtime.COLUMNS_PER_SCAN]
        aggregates, rows = ["count(*) AS total"], []
        for f in group:
            c, i = f.ref, f.ordinal
            numeric = kinds.is_numeric(f.dtype)
            ordered = not isinstance(f.dtype, (T.MapType, T.VariantType))
            # Nested columns are not estimated: a sketch of them would hash whole documents.
            flat = kinds.kind_of(f.dtype) != kinds.OTHER or isinstance(f.dtype, T.BinaryType)
            x = f"CAST({c} AS DOUBLE)"
            aggregates.append(f"count({c}) AS k{i}")
            values = {
                "a": f"CAST(min({c}) AS STRING)" if ordered else "CAST(NULL AS STRING)",
                "z": f"CAST(max({c}) AS STRING)" if ordered else "CAST(NULL AS STRING)",
                "u": f"approx_count_distinct({c})" if flat else "CAST(NULL AS BIGINT)",
                "m": f"avg({x})" if numeric else "CAST(NULL AS DOUBLE)",
                "s": f"stddev({x})" if numeric else "CAST(NULL AS DOUBLE)",
                "q": f"percentile_approx({x}, array(0.25D, 0.5D, 0.75D))" if numeric else "CAST(NULL AS ARRAY<DOUBLE>)",
            }
            aggregates += [f"{sql} AS {part}{i}" for part, sql in values.items()]
            rows.append(
                f"{i}, {literal(f.name)}, {literal(kinds.native_type(f.dtype))}, a{i}, z{i}, u{i}, m{i}, s{i}, "
                f"q{i}[0], q{i}[1], q{i}[2], total, IF(total > 0, round(100D * (total - k{i}) / total, 2), NULL)"
            )
        parts.append(
            f"SELECT stack({len(group)}, {', '.join(rows)}) AS (ordinal, column_name, column_type, min, max, approx_unique, "
            f"avg, std, q25, q50, q75, `count`, null_percentage) FROM (SELECT {', '.join(aggregates)} FROM {{df}})"
        )
    return runtime.query(" UNION ALL ".join(parts), df=plain).orderBy("ordinal")
