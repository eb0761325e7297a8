"""Profile states that merge: the profile of a table that grows, at the cost of the new rows alone.

A state is one row: counts, sums, extremes and, per column, a sketch of its distinct values and one of its
quantiles. States of parts (batches, files, groups) merge into the state of the whole, and a profile is read from any state.
Counts, extremes and means are exact. Distinct counts are estimates (HyperLogLog of 2**12 registers, about 1.6% off at
one standard deviation), and so are the counts of histogram bins and the quartiles (KLL of size 400, ranks about 0.7% off).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..functions import kinds
from ..functions.text import finite, literal, value_text
from . import histogram as hist
from .profile import Field, _family, _finish, _is_summarised, _key, by_ordinal, describe_columns

REGISTERS, SIZE = 12, 400
#: Quantiles by which a sketch is read when the counts of bins are estimated.
MARKS = 500
_WITH_EXTREMES = (kinds.INTEGER, kinds.FLOAT, kinds.DATE, kinds.TEXT)


def _sketched(f: Field) -> str:
    """The value of a cell in a type that sketches take; NULL stays out."""
    key = _key(f)
    if _family(f) == "double":  # both zeros are one value
        return f"IF({f.ref} IS NULL, NULL, xxhash64(IF({key} = 0D, 0D, {key})))"
    return f"CAST({key} AS STRING)" if isinstance(f.dtype, T.DecimalType) else key


def _parts(f: Field) -> list[tuple[str, str, str]]:
    """``name, aggregate over rows, aggregate over states`` of what is kept of a column."""
    i, out = f.ordinal, [(f"n{f.ordinal}", f"count({f.ref})", "sum({})")]
    number = finite(f.ref) if _family(f) == "double" else f.ref
    if kinds.kind_of(f.dtype) in _WITH_EXTREMES:
        out += [(f"a{i}", f"min({number})", "min({})"), (f"z{i}", f"max({number})", "max({})")]
    if _is_summarised(f):
        out.append((f"d{i}", f"hll_sketch_agg({_sketched(f)}, {REGISTERS})", "hll_union_agg({}, false)"))
    if kinds.is_numeric(f.dtype):
        x = f"CAST({number} AS DOUBLE)"
        out += [(f"m{i}", f"count({x})", "sum({})"), (f"s{i}", f"sum({x})", "sum({})"), (f"q{i}", f"kll_sketch_agg_double({x}, {SIZE})", "kll_merge_agg_double({})")]
    return out


def states_of(df: DataFrame, *by: str) -> DataFrame:
    """The state of ``df`` as one row, or with ``by`` one row per group; columns to group by are named ``by0``, ``by1`` and are profiled too."""
    plain, fields = by_ordinal(df)
    keys = [next(f for f in fields if f.name == name) for name in by]
    aggregates = ", ".join(["count(*) AS total", *[f"{rows} AS {name}" for f in fields for name, rows, _ in _parts(f)]])
    named = "".join(f"{f.ref} AS by{i}, " for i, f in enumerate(keys))
    return runtime.query(f"SELECT {named}{aggregates} FROM {{df}}" + (f" GROUP BY {', '.join(f.ref for f in keys)}" if keys else ""), df=plain)


def merge_states(states: DataFrame, schema: T.StructType) -> DataFrame:
    """One state for all rows of ``states``. Only states are read, whatever the tables behind them hold."""
    _, fields = by_ordinal(states.sparkSession.createDataFrame([], schema))
    return states.selectExpr("coalesce(sum(total), 0L) AS total", *[f"{merge.format(name)} AS {name}" for f in fields for name, _, merge in _parts(f)])


def _edges(ranges: str, bins: int) -> str:
    """Bins of each column with the values up to which they count; ``sketch`` and ``m`` come along."""
    below = "IF(is_integer, ceil(lo + i * width) - 0.5D, lo + i * width)"
    return f"SELECT *, transform(sequence(1, bins - 1), i -> {below}) AS edges FROM ({hist.layout_sql(ranges, bins)})"


def profile_of(state: DataFrame, schema: T.StructType, *, bins: int = hist.BINS, ts_style: str = "sql") -> DataFrame:
    """The profile a state of one row tells, in the columns of ``profile``; see the module for what is estimated."""
    table = state.sparkSession.createDataFrame([], schema)
    _, fields = by_ordinal(table)
    none = "CAST(NULL AS {})".format
    rows = []
    for f in fields:
        i, number = f.ordinal, kinds.is_numeric(f.dtype)
        extremes = kinds.kind_of(f.dtype) in _WITH_EXTREMES
        low, high = (value_text(f"{x}{i}", f.dtype, ts_style) if extremes else none("STRING") for x in "az")
        lo, hi = (f"CAST({x}{i} AS DOUBLE)" if number else none("DOUBLE") for x in "az")
        mean = finite(f"try_divide(s{i}, m{i})") if number else none("DOUBLE")
        estimate = f"hll_sketch_estimate(d{i})" if _is_summarised(f) else none("BIGINT")
        rows.append(f"{i}, total, total - coalesce(n{i}, 0L), {estimate}, {low}, {high}, {mean}, {lo}, {hi}, {f'm{i}' if number else none('BIGINT')}, {f'q{i}' if number else none('BINARY')}")
    shares = ", ".join(f"{(i + 0.5) / MARKS}D" for i in range(MARKS))
    integers = ", ".join(str(f.ordinal) for f in fields if kinds.kind_of(f.dtype) == kinds.INTEGER) or "-1"
    stats = runtime.query(
        f"""
        WITH totals AS (SELECT stack({len(fields)}, {', '.join(rows)}) AS (ordinal, rows, nulls, `distinct`, min, max, mean, lo, hi, m, sketch) FROM {{state}}),
        edges AS ({_edges(f"SELECT ordinal, ordinal IN ({integers}) AS is_integer, lo, hi, m, sketch FROM totals WHERE m > 0", bins)}),
        spread AS (SELECT *, kll_sketch_get_quantile_double(sketch, array({shares})) AS marks FROM edges),
        ranks AS (SELECT ordinal, lo, hi, concat(array(0L), transform(edges, e -> CAST(round(size(filter(marks, q -> q < e)) / {MARKS}D * m) AS BIGINT)), array(m)) AS upto FROM spread),
        histograms AS (SELECT ordinal, struct(lo, hi, transform(sequence(1, size(upto) - 1), b -> greatest(0L, get(upto, b) - get(upto, b - 1))) AS counts) AS histogram FROM ranks)
        SELECT /*+ BROADCAST(histograms) */ ordinal, rows, nulls, `distinct`, min, max, mean, histogram, CAST(NULL AS STRING) AS found_kind
        FROM totals LEFT JOIN histograms USING (ordinal)""",
        state=state)
    return _finish(describe_columns(table), stats)


def quartiles_of(state: DataFrame, schema: T.StructType) -> DataFrame:
    """``ordinal, column, q25, q50, q75`` of the numeric columns."""
    _, fields = by_ordinal(state.sparkSession.createDataFrame([], schema))
    numeric = [f for f in fields if kinds.is_numeric(f.dtype)]
    if not numeric:
        return state.sparkSession.createDataFrame([], "ordinal int, column string, q25 double, q50 double, q75 double")
    shares = "array(0.25D, 0.5D, 0.75D)"
    rows = ", ".join(f"{f.ordinal}, {literal(f.name)}, IF(m{f.ordinal} > 0, kll_sketch_get_quantile_double(q{f.ordinal}, {shares}), NULL)" for f in numeric)
    found = runtime.query(f"SELECT stack({len(numeric)}, {rows}) AS (ordinal, column, q) FROM {{state}}", state=state)
    return found.select("ordinal", "column", *[F.expr(f"get(q, {i})").alias(f"q{n}") for i, n in enumerate((25, 50, 75))])


class StateStore:
    """States of the batches of one table under a folder; batch ``n`` reads the total up to ``n - 1`` and its own rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch={batch:08d}"

    def add(self, batch: int, rows: DataFrame) -> DataFrame:
        """The state of all batches up to this one. A batch that is repeated replaces its own total."""
        own = states_of(rows)
        if batch:
            own = merge_states(self.total(batch - 1).unionByName(own), self.schema)
        own.write.mode("overwrite").parquet(self._path(batch))
        return self.total(batch)

    def total(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(self._path(batch))
