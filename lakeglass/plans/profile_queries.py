"""Profiles, histograms and the facts derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runtime
from ..operators.histogram import bins_of
from ..operators.profile import profile, profile_text, profile_variant, report
from ..operators.snapshots import ProfileStore
from ..operators.summarize import summarize
from .registry import Tables, duck_text, register

DECIMALS = 4
FACTS = ["ordinal", "column", "kind", "native_type", "rows", "nulls", "distinct", "min", "max"]


def _facts(p):
    return p.select(*FACTS, F.round("mean", DECIMALS).alias("mean"))


TYPES = {"bigint": ("integer", "BIGINT"), "int": ("integer", "INT"), "double": ("float", "DOUBLE"), "string": ("text", "STRING"),
         "ntz": ("date", "TIMESTAMP_NTZ"), "floats": ("other", "ARRAY<FLOAT>"), "boolean": ("boolean", "BOOLEAN"), "date": ("date", "DATE"),
         "decimal": ("float", "DECIMAL(12,2)")}

COLUMNS = {
    "lineitem": "l_orderkey bigint l_partkey bigint l_suppkey bigint l_linenumber int l_quantity double l_extendedprice double "
                "l_discount double l_tax double l_returnflag string l_linestatus string l_shipdate ntz",
    "orders": "o_orderkey bigint o_custkey bigint o_orderstatus string o_totalprice double o_orderdate ntz o_orderpriority string",
    "customer": "c_custkey bigint c_name string c_nationkey int c_acctbal double c_mktsegment string",
    "supplier": "s_suppkey bigint s_name string s_nationkey int s_acctbal double",
    "part": "p_partkey bigint p_name string p_brand string p_type string p_size int p_retailprice double",
    "events": "event_id bigint ts ntz user_id bigint event_type string value double props string",
    "documents": "doc_id bigint text string lang string source string n_chars bigint",
    "pages": "page_id bigint url string html string",
    "embeddings": "vec_id bigint embedding floats label int",
    "labels": "doc_id bigint quality int toxic int",
    "conversations": "conv_id bigint turn bigint role string text string",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    words = COLUMNS[table].split()
    return list(zip(words[::2], words[1::2]))


def profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """The counterpart of a typed profile: one SELECT per column."""
    parts = []
    for i, (c, type_) in enumerate(columns):
        kind, native = TYPES[type_]
        finite = f"FILTER (WHERE isfinite(CAST({c} AS DOUBLE)))"
        low, high = f"min({c})", f"max({c})"
        if type_ == "double":
            low, high = f"min({c}) {finite}", f"max({c}) {finite}"
        if kind in ("boolean", "other"):
            low = high = "NULL"
        text = (lambda e: f"CASE WHEN {e} IS NOT NULL THEN {duck_text(e, 'double')} END") if type_ == "double" else (lambda e: f"CAST({e} AS VARCHAR)")
        distinct = "CAST(NULL AS BIGINT)" if kind == "other" else f"count(DISTINCT {c})"
        mean = f"round(avg(CAST({c} AS DOUBLE)) {finite}, {DECIMALS})" if kind in ("integer", "float") else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS kind, '{native}' AS native_type, count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"{distinct} AS \"distinct\", "
            f"{text(low)} AS min, {text(high)} AS max, {mean} AS mean FROM {source}"
        )
    return " UNION ALL ".join(parts).replace(f"FILTER (WHERE isfinite", "FILTER (WHERE isfinite")


for _table in COLUMNS:
    register(f"profile_{_table}", lambda t, n=_table: _facts(profile(getattr(t, n))), profile_sql(_table, columns_of(_table)))

# --- null, non-finite, large, decimal and boolean values, all derived from the tables -----------

_SPARSE = """SELECT nullif(o_custkey, 1) AS cust, nullif(o_orderstatus, 'P') AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS price,
    o_orderpriority = '1-URGENT' AS urgent, CAST(o_orderdate AS DATE) AS day, CAST(NULL AS BIGINT) AS nothing FROM {orders}"""
_SPARSE_COLUMNS = [("cust", "bigint"), ("status", "string"), ("price", "decimal"), ("urgent", "boolean"), ("day", "date"), ("nothing", "bigint")]
register("profile_nulls_and_types", lambda t: _facts(profile(t.sql(_SPARSE, "orders"))),
         profile_sql(f"({_SPARSE.replace('{orders}', 'orders')})", _SPARSE_COLUMNS))

_ODD = """SELECT CASE WHEN event_type = 'click' THEN CAST('NaN' AS DOUBLE) WHEN event_type = 'view' THEN CAST('{}Infinity' AS DOUBLE)
    WHEN event_type = 'error' THEN NULL ELSE value END AS x, CAST(event_id + 9007199254740992 AS BIGINT) AS big FROM {events}"""
register("profile_nonfinite_and_large", lambda t: _facts(profile(t.sql(_ODD.replace("'{}Infinity'", "'Infinity'"), "events"))),
         profile_sql(f"({_ODD.replace('{}', '').replace('{events}', 'events')})", [("x", "double"), ("big", "bigint")]))



def _estimated(t: Tables):
    exact = profile(t.lineitem).select("ordinal", "column", "rows", "nulls", "min", "max", F.col("distinct").alias("d"))
    close = F.abs(F.col("distinct") - F.col("d")) <= 0.15 * F.col("d")  # three standard errors of the sketch
    return profile(t.lineitem, distinct="approx").select("ordinal", "distinct").join(exact, "ordinal").select("ordinal", "column", "rows", "nulls", "min", "max", close.alias("is_close"))


register("profile_estimated_distinct", _estimated,
         f'SELECT ordinal, "column", rows, nulls, min, max, true AS is_close FROM ({profile_sql("lineitem", columns_of("lineitem"))})')


def _wide(t: Tables):
    names = t.lineitem.columns
    return t.lineitem.select(*[F.col(c).alias(f"{c}_{k}") for k in range(5) for c in names])


register("profile_wide_table", lambda t: _facts(profile(_wide(t))),
         profile_sql("(SELECT " + ", ".join(f"{c} AS {c}_{k}" for k in range(5) for c, _ in columns_of("lineitem")) + " FROM lineitem)",
                     [(f"{c}_{k}", type_) for k in range(5) for c, type_ in columns_of("lineitem")]))

_JOINED = "SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2"
register("profile_query_result", lambda t: _facts(profile(t.sql(_JOINED, "customer", "nation"))),
         profile_sql(f"({_JOINED.replace('{', '').replace('}', '')})", [("segment", "string"), ("nation", "string"), ("customers", "bigint")]))


def _stored(t: Tables):
    store = ProfileStore(t.spark, runtime.scratch_path(t.spark, "profiles"))
    store.get("part", "1", t.part)
    return _facts(store.get("part", "1", t.part))


register("profile_remembered", _stored, profile_sql("part", columns_of("part")))

# --- report facts -------------------------------------------------------------------------------

_PERCENT = "CASE WHEN {p} > 0 AND {p} < 0.1 THEN '<0.1' ELSE regexp_replace(CAST(CASE WHEN {p} * 4 = floor({p} * 4) THEN round({p}, 1) ELSE CAST(format('{{:.1f}}', CAST({p} AS DOUBLE)) AS DOUBLE) END AS VARCHAR), '\\.0$', '') END"


def _report_sql(source: str, columns: list[tuple[str, str]]) -> str:
    percent = _PERCENT.format(p="(100.0 * nulls / rows)")
    return f"""SELECT ordinal, "column", rows - nulls AS non_null,
        CASE WHEN nulls > 0 THEN format('{{:,}}', nulls) || ' (' || {percent} || '%)' ELSE '0' END AS nulls_text,
        CASE WHEN "distinct" IS NULL THEN '—' ELSE format('{{:,}}', "distinct") END AS distinct_text,
        round(least(1.0, CAST("distinct" AS DOUBLE) / (rows - nulls)), 6) AS distinct_ratio,
        CASE WHEN rows - nulls <= 1 THEN NULL WHEN "distinct" = 1 THEN 'constant' WHEN "distinct" = rows - nulls THEN 'unique' END AS tag,
        CASE WHEN kind = 'date' THEN min || ' → ' || max END AS date_range FROM ({profile_sql(source, columns)})"""


def _report(p):
    return report(p).select("ordinal", "column", "non_null", "nulls_text", "distinct_text", F.round("distinct_ratio", 6).alias("distinct_ratio"), "tag", "date_range")


register("report_events", lambda t: _report(profile(t.events)), _report_sql("events", columns_of("events")))
_SPARSE_REPORT = [c for c in _SPARSE_COLUMNS if c[0] != "nothing"]
register("report_nulls", lambda t: _report(profile(t.sql(_SPARSE, "orders").drop("nothing"))),
         _report_sql(f"({_SPARSE.replace('{orders}', 'orders')})", _SPARSE_REPORT))

# --- histograms -----------------------------------------------------------------------------------


def _bins_sql(source: str, columns: list[tuple[int, str, bool]], tail: str) -> str:
    parts = []
    for ordinal, c, integer in columns:
        bins = "CAST(least(10, floor(hi - lo) + 1) AS INT)" if integer else "10"
        width = "(hi - lo + 1) / bins" if integer else "(hi - lo) / bins"
        parts.append(f"""
            SELECT {ordinal} AS ordinal, '{c}' AS "column", {str(integer).lower()} AS is_int, b.bucket, lo, hi, bins, width, count(x) AS "count"
            FROM (SELECT *, {width} AS width FROM (SELECT *, {bins} AS bins FROM (
                SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {source}))) AS l
            JOIN (SELECT CAST(range AS INT) AS bucket FROM range(10)) AS b ON b.bucket < l.bins
            LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS x FROM {source}) AS v
                ON CAST(least(greatest(floor((x - lo) / width), 0), bins - 1) AS INT) = b.bucket
            GROUP BY ALL""")
    return f"SELECT {tail} FROM ({' UNION ALL '.join(parts)})"


_EDGE_TEXT = "regexp_replace(format('{{:.6g}}', {x}), '^-0$', '0')"
_FROM, _TO = "lo + bucket * width", "CASE WHEN bucket = bins - 1 THEN hi ELSE lo + (bucket + 1) * width END"
_NUMBER = "CASE WHEN {x} = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE " + _EDGE_TEXT + " END"
_FIRST = "ceil(floor((lo + bucket * width) * 1e6 + 0.5) / 1e6)"
_END = "(CASE WHEN bucket = bins - 1 THEN hi ELSE ceil(floor((lo + (bucket + 1) * width) * 1e6 + 0.5) / 1e6) - 1 END)"
_LABEL = (
    f"CASE WHEN is_int AND {_FIRST} >= {_END} THEN format('{{:,}}', CAST({_FIRST} AS BIGINT)) "
    f"WHEN is_int THEN format('{{:,}}', CAST({_FIRST} AS BIGINT)) || '–' || format('{{:,}}', CAST({_END} AS BIGINT)) "
    f"ELSE '[' || {_NUMBER.format(x=f'({_FROM})')} || ', ' || {_NUMBER.format(x=f'({_TO})')} || CASE WHEN bucket = bins - 1 THEN ']' ELSE ')' END END"
)
_SHARE = _PERCENT.format(p='(100.0 * "count" / sum("count") OVER (PARTITION BY ordinal))')
_BINS = f"""ordinal, "column", bucket, {_LABEL} AS label, "count", {_SHARE} AS share,
    row_number() OVER (PARTITION BY ordinal ORDER BY "count" DESC, bucket) = 1 AS is_peak"""

register("histogram_lineitem", lambda t: bins_of(profile(t.lineitem)), _bins_sql("lineitem", [
    (0, "l_orderkey", True), (1, "l_partkey", True), (2, "l_suppkey", True), (3, "l_linenumber", True),
    (4, "l_quantity", False), (5, "l_extendedprice", False), (6, "l_discount", False), (7, "l_tax", False)], _BINS))
register("histogram_part", lambda t: bins_of(profile(t.part.select("p_size", "p_retailprice"))),
         _bins_sql("part", [(0, "p_size", True), (1, "p_retailprice", False)], _BINS))
register("histogram_five_bins", lambda t: profile(t.orders.select("o_totalprice"), bins=5).selectExpr(
    "column", "histogram.lo AS lo", "histogram.hi AS hi", "posexplode(histogram.counts) AS (bucket, `count`)"),
    """SELECT 'o_totalprice' AS "column", lo, hi, bucket, count(x) AS "count" FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       JOIN (SELECT CAST(range AS INT) AS bucket FROM range(5)) ON true LEFT JOIN (SELECT o_totalprice AS x FROM orders)
       ON least(CAST(floor((x - lo) / ((hi - lo) / 5)) AS INT), 4) = bucket GROUP BY ALL""")

# --- kinds inferred from text ----------------------------------------------------------------------

_TEXTS = """SELECT CAST(o_orderkey AS STRING) AS plain_int, concat('00', CAST(o_custkey AS STRING)) AS padded, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS price,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day,
    CASE WHEN o_orderstatus = 'F' THEN 'True' WHEN o_orderstatus = 'O' THEN 'FALSE' ELSE '  ' END AS flag,
    CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_custkey AS STRING) END AS mixed,
    concat(' ', o_orderpriority) AS words, concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:00:00+02:00') AS zoned FROM {orders}"""
_DUCK_TEXTS = _TEXTS.replace("{orders}", "orders").replace("STRING", "VARCHAR")


def _inferred_sql() -> str:
    sources = [("plain_int", "integer"), ("padded", "text"), ("price", "float"), ("day", "date"), ("flag", "boolean"), ("mixed", "mixed"),
               ("words", "text"), ("zoned", "date")]
    parts = []
    for i, (c, _) in enumerate(sources):
        s = f"nullif(trim({c}), '')"
        parts.append(f"""
            SELECT {i} AS ordinal, '{c}' AS "column", count(*) AS rows, count(*) - count(s) AS nulls,
                CASE WHEN (ints + floats > 0)::INT + (bools > 0)::INT + (dates > 0)::INT + (texts > 0)::INT > 1 THEN 'mixed' WHEN floats > 0 THEN 'float'
                     WHEN ints > 0 THEN 'integer' WHEN bools > 0 THEN 'boolean' WHEN dates > 0 THEN 'date' ELSE 'text' END AS kind,
                count(DISTINCT CASE k WHEN 'boolean' THEN lower(s) WHEN 'integer' THEN CAST(CAST(s AS DOUBLE) AS VARCHAR)
                                      WHEN 'float' THEN CAST(CAST(s AS DOUBLE) AS VARCHAR) ELSE s END) AS "distinct",
                CASE WHEN kind IN ('text', 'date') THEN min(s) WHEN kind IN ('integer', 'float') THEN arg_min(s, CASE WHEN k IN ('integer', 'float') THEN CAST(s AS DOUBLE) END) END AS min,
                CASE WHEN kind IN ('text', 'date') THEN max(s) WHEN kind IN ('integer', 'float') THEN arg_max(s, CASE WHEN k IN ('integer', 'float') THEN CAST(s AS DOUBLE) END) END AS max,
                CASE WHEN kind IN ('integer', 'float') THEN round(avg(CASE WHEN k IN ('integer', 'float') THEN CAST(s AS DOUBLE) END), {DECIMALS}) END AS mean
            FROM (SELECT *, count(*) FILTER (k = 'integer') OVER () AS ints, count(*) FILTER (k = 'float') OVER () AS floats, count(*) FILTER (k = 'boolean') OVER () AS bools,
                         count(*) FILTER (k = 'date') OVER () AS dates, count(*) FILTER (k = 'text') OVER () AS texts
                  FROM (SELECT s, CASE WHEN s IS NULL THEN NULL WHEN regexp_full_match(s, '[+-]?(0|[1-9][0-9]*)') THEN 'integer'
                      WHEN regexp_full_match(s, '[+-]?((0|[1-9][0-9]*)(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
                      WHEN regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(s AS TIMESTAMPTZ) IS NOT NULL THEN 'date'
                      WHEN lower(s) IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS k FROM (SELECT {s} AS s FROM ({_DUCK_TEXTS}))))
            GROUP BY ints, floats, bools, dates, texts""")
    return " UNION ALL ".join(parts)


_INFERRED = ["ordinal", "column", "rows", "nulls", "kind", "distinct", "min", "max"]
register("inferred_kinds", lambda t: profile_text(t.sql(_TEXTS, "orders")).select(*_INFERRED, F.round("mean", DECIMALS).alias("mean")), _inferred_sql())
register("inferred_histogram", lambda t: bins_of(profile_text(t.part.selectExpr("CAST(p_size AS STRING) AS p_size", "CAST(p_retailprice AS STRING) AS p_retailprice"))),
         _bins_sql("part", [(0, "p_size", True), (1, "p_retailprice", False)], _BINS))

_VARIANTS = """SELECT parse_json(props) AS props, variant_get(parse_json(props), '$.k') AS k,
    CASE WHEN event_type = 'click' THEN parse_json(CAST(user_id AS STRING)) WHEN event_type = 'view' THEN parse_json(concat('"', event_type, '"'))
         WHEN event_type = 'error' THEN NULL ELSE parse_json('2.5') END AS mixed, parse_json(concat('"', event_type, '"')) AS words FROM {events}"""
register("stored_class_kinds", lambda t: profile_variant(t.sql(_VARIANTS, "events")).select(*_INFERRED, F.round("mean", DECIMALS).alias("mean")), f"""
    SELECT 0 AS ordinal, 'props' AS "column", count(*) AS rows, 0 AS nulls, 'other' AS kind, NULL AS "distinct", NULL AS min, NULL AS max, NULL AS mean FROM events
    UNION ALL SELECT 1, 'k', count(*), 0, 'integer', count(DISTINCT k), CAST(min(k) AS VARCHAR), CAST(max(k) AS VARCHAR), round(avg(k), {DECIMALS})
        FROM (SELECT CAST(props->>'k' AS BIGINT) AS k FROM events)
    UNION ALL SELECT 2, 'mixed', count(*), count(*) FILTER (event_type = 'error'), 'mixed',
        count(DISTINCT CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'v' WHEN 'error' THEN NULL ELSE '2.5' END), NULL, NULL, NULL FROM events
    UNION ALL SELECT 3, 'words', count(*), 0, 'text', count(DISTINCT event_type), min(event_type), max(event_type), NULL FROM events""")

# --- schemas and summaries ---------------------------------------------------------------------------

register("summarize_orders", lambda t: summarize(t.orders).selectExpr(
    "ordinal", "column_name", "column_type", "min", "max", "`count`", "null_percentage", "round(avg, 4) AS avg", "round(std, 4) AS std"),
    " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, '{TYPES[k][1]}' AS column_type, {duck_text(f'min({c})', k)} AS min, {duck_text(f'max({c})', k)} AS max, count(*) AS \"count\", 0.0 AS null_percentage, "
        + (f"round(avg(CAST({c} AS DOUBLE)), 4) AS avg, round(stddev(CAST({c} AS DOUBLE)), 4) AS std" if k in ("bigint", "int", "double") else "NULL AS avg, NULL AS std")
        + " FROM orders" for i, (c, k) in enumerate(columns_of("orders"))))
