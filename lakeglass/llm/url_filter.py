"""URL filters against dated lists, in DataFrame operations only.

A list is a table of events ``list, kind, value, at, action``: at a moment an entry is added to or removed from a list.
Events become validity intervals, from an addition to the next event of the same entry. A capture is evaluated against
the entries valid when it was fetched: ``from <= fetched < to``.

Kinds: ``host`` is one host, ``domain`` a host and all below it, ``prefix`` a host and the beginning of a path, whole
segments. A URL offers all keys it could be listed by, and an equality join on them with the interval as a condition finds
the entries. Intervals of one entry do not overlap, so a key of a capture meets at most one of each list. A hot host is
a large group on one side only, which Spark splits; intervals are broadcast up to ``BROADCAST_ENTRIES``.

Defined results: URLs that are null or have no host match nothing and are kept, as is a capture without a time.
Events with a null field other than the list are void. At one moment an addition wins over a removal; repeated events count once.
Repeated captures get the same result each. Results replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeglass.llm.shared import replacing, written

BROADCAST_ENTRIES = 500_000


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL without user, port and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without its first slash, query and fragment."""
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """All ``kind, value`` pairs by which a URL may be listed."""
    host = host_of(url)
    labels, segments = F.split(host, r"\."), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda i: F.concat_ws("/", host, F.slice(segments, F.lit(1), i)))

    def pairs(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(pairs("host", F.array(host)), pairs("domain", suffixes), pairs("prefix", heads))
    return F.when(host.isNotNull(), F.array_distinct(every))


def intervals(events: DataFrame) -> DataFrame:
    """``list, kind, value, valid_from, valid_to``; an entry that was never removed has no ``valid_to``."""
    whole = events.select("list", "kind", "value", "at", "action").where(
        "kind IS NOT NULL AND value IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    once = whole.groupBy("list", "kind", "value", "at").agg(F.min("action").alias("action"))  # 'add' comes first
    after = F.lead("at").over(W.partitionBy("list", "kind", "value").orderBy("at"))
    return once.withColumn("valid_to", after).where("action = 'add'").select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``n_entries`` (entries that applied), ``lists`` (sorted) and ``blocked``."""
    valid, _ = written(intervals(events), "intervals")
    entries = F.broadcast(valid) if valid.count() <= BROADCAST_ENTRIES else valid
    base = replacing(captures, "host", "n_entries", "lists", "blocked")
    wanted = base.select(F.col(url).alias("url"), F.col(fetched).alias("at")).where("url IS NOT NULL AND at IS NOT NULL").distinct()
    keys = wanted.select("url", "at", F.explode(keys_of(F.col("url"))).alias("k")).select("url", "at", "k.kind", "k.value")
    met = keys.join(entries, ["kind", "value"]).where("valid_from <= at AND (valid_to IS NULL OR at < valid_to)")
    found = met.groupBy("url", "at").agg(F.count("*").alias("n_entries"), F.array_sort(F.collect_set("list")).alias("lists"))
    named = found.select(F.col("url").alias("_url"), F.col("at").alias("_at"), F.col("n_entries").alias("_n"), F.col("lists").alias("_lists"))
    joined = base.join(named, (F.col(url) == F.col("_url")) & (F.col(fetched) == F.col("_at")), "left")
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    return joined.withColumns({"host": host_of(F.col(url)), "n_entries": n, "lists": F.coalesce("_lists", F.array().cast("array<string>")), "blocked": n > 0}).drop("_url", "_at", "_n", "_lists")


def allowed(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures that no entry forbade when they were fetched, with their own columns."""
    return evaluate(captures, events, url, fetched).where("NOT blocked").select(*captures.columns)


def _number(value: str) -> str:
    """A number from 0 to 65535 that Spark and DuckDB derive alike from a text."""
    return f"CAST(conv(substr(md5({value}), 1, 4), 16, 10) AS INT)"


def _derived(number, days, at) -> tuple[str, str]:
    """SQL of the test captures and list events, both derived from ``pages``."""
    h = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
    captures = f"SELECT page_id, url, {days('page_id % 366')} AS fetched_at FROM pages"
    hosts = f"SELECT DISTINCT {h} AS host, {h} || '/' || regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS head FROM pages"
    values = f"""SELECT DISTINCT 'spam' AS list, 'host' AS kind, host AS value FROM ({hosts}) WHERE {number('host')} % 5 = 0
UNION SELECT DISTINCT 'adult', 'domain', regexp_replace(host, '^(m|blog|www)[.]', '') FROM ({hosts}) WHERE {number('host')} % 4 = 1
UNION SELECT DISTINCT 'legal', 'prefix', head FROM ({hosts}) WHERE {number('head')} % 3 = 0"""
    first, second, third = "n % 200", "n % 200 + 30 + n % 90", "n % 200 + 150 + n % 120"
    events = f"""SELECT list, kind, value, {days(first)} AS {at}, 'add' AS action FROM (SELECT *, {number('value')} AS n FROM ({values}))
UNION ALL SELECT list, kind, value, {days(second)}, 'remove' FROM (SELECT *, {number('value')} AS n FROM ({values})) WHERE n % 3 <> 0
UNION ALL SELECT list, kind, value, {days(third)}, 'add' FROM (SELECT *, {number('value')} AS n FROM ({values})) WHERE n % 3 = 1"""
    return captures, events


CAPTURES, EVENTS = _derived(_number, lambda n: f"date_add(DATE'2024-01-01', CAST({n} AS INT))", "at")

_DUCK_CAPTURES, _DUCK_EVENTS = _derived(
    lambda v: f"CAST('0x' || substr(md5({v}), 1, 4) AS INTEGER)", lambda n: f"(DATE '2024-01-01' + CAST({n} AS INTEGER))", '"at"')

#: Every capture against every entry, in DuckDB.
ORACLE = f"""
WITH c AS ({_DUCK_CAPTURES}), e AS ({_DUCK_EVENTS}),
o AS (SELECT list, kind, value, "at", min(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead("at") OVER (PARTITION BY list, kind, value ORDER BY "at") AS until FROM o),
p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path FROM c),
m AS (SELECT p.page_id, i.list FROM p JOIN i ON i.action = 'add' AND i."at" <= p.fetched_at AND (i.until IS NULL OR p.fetched_at < i.until)
  AND (i.kind = 'host' AND p.host = i.value OR i.kind = 'domain' AND (p.host = i.value OR ends_with(p.host, '.' || i.value))
       OR i.kind = 'prefix' AND starts_with(p.host || '/' || p.path || '/', i.value || '/'))),
n AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM m GROUP BY 1)
SELECT p.page_id, p.host, p.fetched_at, CAST(coalesce(n.n, 0) AS BIGINT) AS n_entries, coalesce(n.lists, '') AS lists, coalesce(n.n, 0) > 0 AS blocked FROM p LEFT JOIN n USING (page_id)"""
