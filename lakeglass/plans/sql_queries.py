"""What users reach through the SQL box, and the joins Spark has no word for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import asof_join, range_join, span_overlap_join
from ..operators.profile import profile
from .registry import Tables, register
from .sqlbox import SqlBox, result_facts

NAMES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


def _box(t: Tables) -> SqlBox:
    for name in NAMES:
        getattr(t, name).createOrReplaceTempView(name)
    return SqlBox(t.spark)


def guarded(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that goes through the guard; the counterpart is the same text unless given, '' is none."""
    register(f"sql_{name}", lambda t: _box(t).query(sql), None if oracle == "" else oracle or sql)


guarded("join_group", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
guarded("left_join", "SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
guarded("right_join", "SELECT d.doc_id, quality, toxic FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
guarded("full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
guarded("semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
guarded("anti_join", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
guarded("group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 12")
guarded("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
guarded("grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
        "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
guarded("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
guarded("rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
guarded("pivot_listed", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
guarded("pivot_dynamic", "PIVOT orders ON o_orderstatus USING max(o_custkey) GROUP BY o_orderpriority",
        "SELECT o_orderpriority, max(o_custkey) FILTER (o_orderstatus = 'F') AS F, max(o_custkey) FILTER (o_orderstatus = 'O') AS O, max(o_custkey) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
guarded("unpivot", "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (amount FOR fact IN (size, price))",
        "SELECT p_partkey, 'size' AS fact, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
guarded("window_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
        "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
guarded("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
guarded("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
guarded("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
guarded("intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
guarded("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
guarded("except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
guarded("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
guarded("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT n, count(*) AS customers FROM per GROUP BY n")
guarded("from_first", "FROM supplier", "SELECT * FROM supplier")
guarded("summarize", "SUMMARIZE events", "")
guarded("range_function", "SELECT id, count(o_orderkey) AS n FROM range(8) LEFT JOIN orders ON o_custkey = id GROUP BY id", "SELECT range AS id, count(o_orderkey) AS n FROM range(8) LEFT JOIN orders ON o_custkey = range GROUP BY 1")
guarded("explode", "SELECT word, count(*) AS n FROM part LATERAL VIEW explode(split(p_name, ' ')) AS word GROUP BY word", "SELECT unnest(string_split(p_name, ' ')) AS word, count(*) AS n FROM part GROUP BY 1")
guarded("case_and_casts", "SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_custkey AS STRING) AS cust, try_cast(left(o_orderpriority, 1) AS INT) AS prio, try_cast(o_orderpriority AS INT) AS no FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_custkey AS VARCHAR) AS cust, try_cast(left(o_orderpriority, 1) AS INT) AS prio, try_cast(o_orderpriority AS INT) AS no FROM orders")
guarded("collate", "SELECT count(*) AS n FROM part WHERE p_type COLLATE UTF8_LCASE = 'economy'", "SELECT count(*) AS n FROM part WHERE lower(p_type) = 'economy'")
guarded("lists_and_structs", "SELECT n_regionkey, size(array_sort(collect_list(n_nationkey))) AS n, to_json(named_struct('first', min(n_name), 'last', max(n_name))) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, len(list(n_nationkey)) AS n, CAST(to_json({'first': min(n_name), 'last': max(n_name)}) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey")
guarded("text_and_math", "SELECT n_nationkey, repeat(left(n_name, 2), 3) AS r, upper(n_name) || '!' AS u, floor(n_nationkey / 4) AS q, least(n_nationkey, 10) AS m, abs(n_regionkey - 3) AS a, lower(hex(n_name)) AS h, trim('  ' || n_name) AS t FROM nation",
        "SELECT n_nationkey, repeat(left(n_name, 2), 3) AS r, upper(n_name) || '!' AS u, CAST(floor(n_nationkey / 4) AS BIGINT) AS q, least(n_nationkey, 10) AS m, abs(n_regionkey - 3) AS a, lower(hex(CAST(n_name AS BLOB))) AS h, trim('  ' || n_name) AS t FROM nation")
guarded("patterns_and_dates", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k, props RLIKE '[13579]}$' AS odd, to_date(ts) AS day, date_format(ts, 'yyyy-MM') AS month FROM events",
        "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k, regexp_matches(props, '[13579]}$') AS odd, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m') AS month FROM events")
guarded("last_statement_wins", "SELECT count(*) FROM orders; -- ;\nSELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
        "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
register("sql_tablesample_share", lambda t: _box(t).query(
    """SELECT n, abs(s - 0.2D * n) <= 6 * sqrt(0.16D * n) AS share_is_right
       FROM (SELECT count(*) AS s, (SELECT count(*) FROM lineitem) AS n FROM lineitem TABLESAMPLE (20 PERCENT) REPEATABLE (7))"""),
    "SELECT count(*) AS n, true AS share_is_right FROM lineitem")
register("sql_tablesample", lambda t: _box(t).query("SELECT * FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)"))


def _kept(t: Tables, sql: str) -> SqlBox:
    box = _box(t)
    outcome = box.run(sql, 100, result_id=1)
    if outcome.error:
        raise ValueError(outcome.error)
    return box


# More rows than any page shows: three columns of every line item, one under the other.
_KEPT = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS fact, {c} AS amount FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))
register("result_facts", lambda t: result_facts(t.lineitem, 5000), "SELECT least(count(*), 5000) AS shown_rows, count(*) AS kept_rows, count(*) > 5000 AS truncated FROM lineitem")
register("result_kept", lambda t: _kept(t, _KEPT).result(1), _KEPT)
register("result_filtered", lambda t: _kept(t, _KEPT).filter(1, {"amount": ">40", "fact": "!PRICE"}), f"SELECT * FROM ({_KEPT}) WHERE amount > 40 AND NOT contains(lower(fact), 'price')")
register("result_profiled", lambda t: _kept(t, _KEPT).profile(1).select("ordinal", "column", "kind", "rows", "distinct"),
         " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows, count(DISTINCT {c}) AS \"distinct\" FROM ({_KEPT})"
                            for i, (c, k) in enumerate([("l_orderkey", "integer"), ("l_linenumber", "integer"), ("fact", "text"), ("amount", "float")])))


def _drop_old(t: Tables):
    box = _kept(t, _KEPT)
    box.run("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", 100, result_id=2)
    box.drop(1)
    return box.result(2)


register("result_newest_survives_drop", _drop_old, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")

# --- joins -------------------------------------------------------------------------------------------------
_SPOTTY = "SELECT event_id AS `event id`, nullif(user_id, 3) AS `user id`, nullif(ts, TIMESTAMP_NTZ'2024-01-05 00:00:00') AS at, event_type AS `seen type`, value FROM {events} WHERE event_type {is} 'click'"


def _spotty(t: Tables, test: str):
    """Events with users and times left out, under names with blanks."""
    found = t.sql(_SPOTTY.replace("{is}", test), "events")
    return found.withColumn("at", F.when(F.col("event id") % 11 != 0, F.col("at")))


_DUCK_SPOTTY = """SELECT event_id AS "event id", nullif(user_id, 3) AS "user id", CASE WHEN event_id % 11 <> 0 THEN ts END AS at_, event_type, value FROM events WHERE event_type {is} 'click'"""
register("asof_join", lambda t: asof_join(_spotty(t, "=").select("event id", "user id", "at"), _spotty(t, "<>"), "user id", "at", ["seen type", "value"]).withColumnRenamed("at", "at_"),
    f"""SELECT l."event id", l."user id", l.at_, r.event_type AS "seen type", r.value FROM ({_DUCK_SPOTTY.replace('{is}', '=')}) l
        ASOF LEFT JOIN ({_DUCK_SPOTTY.replace('{is}', '<>')}) r ON l."user id" = r."user id" AND l.at_ >= r.at_""")
_SPANS = """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_retailprice * 100 END AS lo,
    CASE WHEN p_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN p_partkey % 89 = 0 THEN 1e9 WHEN p_partkey % 10 = 1 THEN p_retailprice * 100 + p_size END AS hi FROM {part}"""
register("range_join", lambda t: range_join(t.orders.selectExpr("o_orderkey", "IF(o_orderkey % 7 = 0, NULL, o_totalprice) AS `total price`"), t.sql(_SPANS, "part"), "total price", "lo", "hi", 50.0),
    f"""SELECT o_orderkey, o_totalprice AS "total price", p_partkey, lo, hi FROM orders JOIN ({_SPANS.replace('{part}', 'part')}) ON o_totalprice >= lo AND o_totalprice < hi WHERE o_orderkey % 7 <> 0""")
_HOLDINGS = """SELECT s_suppkey, CASE WHEN s_suppkey % 40 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN s_suppkey % 41 <> 0 THEN 90000 + s_acctbal * 10 END AS "from",
    CASE WHEN s_suppkey % 40 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 90000 + s_acctbal * 10 + s_suppkey % 7 * 100 END AS lo FROM supplier"""
register("span_overlap_join", lambda t: span_overlap_join(t.sql(_SPANS, "part"), t.sql(_HOLDINGS.replace('"', "`").replace("FROM supplier", "FROM {supplier}"), "supplier").withColumnRenamed("lo", "to"),
                                                          "lo", "hi", "from", "to"),
    f"""SELECT p.*, s_suppkey, "from", s.lo AS "to" FROM ({_SPANS.replace('{part}', 'part')}) AS p JOIN ({_HOLDINGS}) AS s ON p.lo < s.lo AND "from" < hi WHERE p.lo < hi AND "from" < s.lo""")
register("span_overlap_join_of_times", lambda t: span_overlap_join(
    t.sql("SELECT user_id, event_type, min(ts) AS began, max(ts) AS ended FROM {events} GROUP BY user_id, event_type", "events"),
    t.sql("SELECT date_trunc('DAY', o_orderdate) AS day, date_trunc('DAY', o_orderdate) + INTERVAL '1' DAY AS next_day, count(*) AS n FROM {orders} WHERE o_orderdate >= '1997-01-01' GROUP BY 1, 2", "orders")
     .selectExpr("day + make_interval(27) AS day", "next_day + make_interval(27) AS next_day", "n"), "began", "ended", "day", "next_day"),
    """SELECT * FROM (SELECT user_id, event_type, min(ts) AS began, max(ts) AS ended FROM events GROUP BY user_id, event_type)
       JOIN (SELECT date_trunc('day', o_orderdate) + INTERVAL 27 YEAR AS day, date_trunc('day', o_orderdate) + INTERVAL 1 DAY + INTERVAL 27 YEAR AS next_day, count(*) AS n
             FROM orders WHERE o_orderdate >= '1997-01-01' GROUP BY 1, 2) ON began < next_day AND day < ended WHERE began < ended""")
