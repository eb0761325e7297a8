"""Display, sources, filters, ranges, catalog, manifests and refresh."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import kinds
from ..operators import catalog, dbt, filters, ranges, snapshots, states, table
from ..operators.profile import by_ordinal, profile
from ..operators.ranges import Range
from ..operators.summarize import summarize
from ..sources import csv, files, tsv
from ..streaming import refresh
from .profile_queries import columns_of, profile_sql
from .registry import Tables, duck_text, register


def shown_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return "SELECT " + ", ".join(f"{duck_text(c, k)} AS {c}" for c, k in columns) + f" FROM {source}"


# --- display -------------------------------------------------------------------------------------------
for _t in ("lineitem", "events", "customer"):
    register(f"display_{_t}", lambda t, n=_t: table.shown_text(getattr(t, n)), shown_sql(_t, columns_of(_t)))
register("display_nested", lambda t: table.shown_text(t.sql(
    "SELECT n_nationkey, named_struct('name', n_name, 'none', CAST(NULL AS STRING), 'keys', array(n_nationkey, n_regionkey)) AS cell, CAST(n_name AS BINARY) AS raw FROM {nation}", "nation")),
    "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(to_json({'name': n_name, 'none': NULL, 'keys': [n_nationkey, n_regionkey]}) AS VARCHAR) AS cell, lower(hex(CAST(n_name AS BLOB))) AS raw FROM nation")
register("head_with_order", lambda t: table.head(t.orders, 100, ["o_orderkey"]),
         shown_sql("(SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)", columns_of("orders")))
register("head_size_facts", lambda t: table.size_facts(t.lineitem, 5000),
         "SELECT count(*) AS total_rows, least(count(*), 5000) AS shown_rows, count(*) > 5000 AS truncated, 11 AS column_count FROM lineitem")
register("ordinal_columns", lambda t: (lambda d: by_ordinal(d)[0])(
    t.sql("SELECT n.n_name AS name, r.r_name AS name, n.n_nationkey AS `a b` FROM {nation} n JOIN {region} r ON n_regionkey = r_regionkey", "nation", "region")),
    "SELECT n_name AS c0, r_name AS c1, n_nationkey AS c2 FROM nation JOIN region ON n_regionkey = r_regionkey")
register("row_index", lambda t: table.with_row_index(t.events.select("event_id", "ts"), ["ts", "event_id"]),
         "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events")
_MIXED = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS {S}) WHEN o_orderstatus = 'O' THEN o_orderpriority END AS v FROM {orders}"
register("sort_text_as_numbers", lambda t: table.sorted_with_position(t.sql(_MIXED.replace("{S}", "STRING"), "orders"), "v", ["o_orderkey"]),
    f"""SELECT o_orderkey, v, row_number() OVER (ORDER BY v IS NULL, try_cast(v AS DOUBLE) IS NULL, try_cast(v AS DOUBLE), CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END, o_orderkey) - 1 AS position
        FROM ({_MIXED.replace("{S}", "VARCHAR").replace("{orders}", "orders")})""")
_FOUND = " UNION ALL ".join(f"SELECT p_partkey AS row_id, {i} AS ordinal, '{c}' AS \"column\", {duck_text(c, k)} AS cell FROM part" for i, (c, k) in enumerate(columns_of("part")))
register("find_cells", lambda t: table.find(t.part, "RED", "p_partkey"),
         f"SELECT * FROM ({_FOUND}) WHERE contains(lower(cell), 'red')")
register("find_cell_count", lambda t: table.find_count(t.part, "17", "p_partkey"),
         f"SELECT count(*) AS cells, count(DISTINCT row_id) AS rows FROM ({_FOUND}) WHERE contains(lower(cell), '17')")


# --- sources -------------------------------------------------------------------------------------------
def _as_csv(t: Tables, name: str, sep: str = ","):
    path = runtime.scratch_path(t.spark, name)
    table.shown_text(getattr(t, name)).write.csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="", nullValue="")
    return path


register("scan_parquet", lambda t: t.supplier, "SELECT * FROM supplier")
register("scan_csv_text", lambda t: csv.read_csv(t.spark, _as_csv(t, "part")), shown_sql("part", columns_of("part")))
register("scan_csv_line_breaks", lambda t: csv.read_csv(t.spark, _as_csv(t, "conversations"), line_breaks=True), shown_sql("conversations", columns_of("conversations")))
register("scan_csv_whole_documents", lambda t: csv.read_csv(t.spark, _as_csv(t, "documents"), ",", line_breaks=True).selectExpr("doc_id", "lang", "length(text) AS chars", "md5(text) AS digest"),
         "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, length(text) AS chars, md5(text) AS digest FROM documents")
register("scan_csv_typed", lambda t: csv.read_csv_typed(t.spark, _as_csv(t, "orders", "|")).selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey", "o_orderstatus", "o_totalprice", "typeof(o_orderdate) AS date_type"),
         "SELECT o_orderkey, o_orderstatus, o_totalprice, 'timestamp' AS date_type FROM orders")
register("sniff_delimiters", lambda t: (lambda p: csv.sniff_delimiters(t.spark, p).select("delimiter").distinct().withColumn("rows", F.lit(csv.read_csv(t.spark, p).count())))(_as_csv(t, "customer", ";")),
         "SELECT ';' AS delimiter, CAST(count(*) AS INT) AS rows FROM customer")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _file_relations(t: Tables):
    parts = [
        t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("approx_rows")).select(
            F.lit("default" if len(files.view_name(path)) < 7 else "wide").alias("schema"), F.lit(files.view_name(path)).alias("name"), F.lit("table").alias("type"), "approx_rows")
        for path in files.list_files(t.spark, t.folder) if files.view_name(path) in TABLES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_FILE_RELATIONS = " UNION ALL ".join(f"SELECT '{'default' if len(n) < 7 else 'wide'}' AS schema, '{n}' AS name, 'table' AS type, count(*) AS approx_rows FROM {n}" for n in TABLES)
register("file_views", lambda t: (files.create_views(t.spark, [p for p in files.list_files(t.spark, t.folder) if files.view_name(p) in ("nation", "region")]),
                                  t.spark.sql("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"))[1],
         "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
register("tsv_written_and_read", lambda t: (lambda p: (tsv.write_tsv(t.conversations, p), tsv.read_tsv(t.spark, p))[1])(runtime.scratch_path(t.spark, "tsv")),
         shown_sql("conversations", columns_of("conversations")))

# --- catalog -------------------------------------------------------------------------------------------
_ID = "CASE WHEN schema = 'default' THEN name ELSE schema || '.' || name END"
register("catalog_listing", lambda t: catalog.relations(_file_relations(t)), f"SELECT schema, name, type, approx_rows, {_ID} AS id FROM ({_FILE_RELATIONS})")


def _session_catalog(t: Tables):
    """Tables of two schemas of the session, with and without statistics, and a view; they are listed and dropped again."""
    spark, schemas = t.spark, ("lakeglass_probe_a", "lakeglass_probe_b")
    for schema in schemas:
        spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
        spark.sql(f"CREATE SCHEMA {schema}")
    for schema, name in zip(schemas * 2, ("nation", "supplier", "region", "customer")):
        getattr(t, name).write.saveAsTable(f"{schema}.{name}")
        if name != "region":
            spark.sql(f"ANALYZE TABLE {schema}.{name} COMPUTE STATISTICS")
    spark.sql("CREATE VIEW lakeglass_probe_a.asia AS SELECT * FROM lakeglass_probe_a.region WHERE r_name = 'ASIA'")
    found = runtime.materialize(catalog.relations(catalog.session_relations(spark)).where("startswith(schema, 'lakeglass_probe')"), "catalog")
    for schema in schemas:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")
    return found


register("catalog_of_session", _session_catalog, " UNION ALL ".join(
    f"SELECT 'lakeglass_probe_{s}' AS schema, '{n}' AS name, '{k}' AS type, {'count(*)' if rows else 'NULL::BIGINT'} AS approx_rows, 'lakeglass_probe_{s}.{n}' AS id FROM {src}"
    for s, n, k, rows, src in (("a", "nation", "table", 1, "nation"), ("b", "supplier", "table", 1, "supplier"), ("a", "region", "table", 0, "(SELECT 1)"),
                               ("b", "customer", "table", 1, "customer"), ("a", "asia", "view", 0, "(SELECT 1)"))))
register("catalog_search", lambda t: catalog.search(_file_relations(t), " ER "), f"SELECT schema, name, type, approx_rows, {_ID} AS id FROM ({_FILE_RELATIONS}) WHERE contains(lower({_ID}), 'er')")
register("catalog_search_counts", lambda t: catalog.search_counts(t.sql("SELECT c_mktsegment AS schema, c_name AS name, 'table' AS type, c_custkey AS approx_rows FROM {customer}", "customer"), "#00000001"),
         "SELECT c_mktsegment AS schema, count(*) AS matches FROM customer WHERE contains(lower(c_mktsegment || '.' || c_name), '#00000001') GROUP BY 1")
register("catalog_resolve", lambda t: catalog.resolve(
    t.sql("SELECT lower(c_mktsegment) AS schema, IF(c_nationkey = 3, c_name, upper(c_name)) AS name FROM {customer}", "customer"),
    t.sql("SELECT c_mktsegment AS schema, c_name AS name FROM {customer} UNION ALL SELECT lower(c_mktsegment), c_name FROM {customer} WHERE c_nationkey = 3", "customer")),
    """SELECT lower(c_mktsegment) AS target_schema, CASE WHEN c_nationkey = 3 THEN c_name ELSE upper(c_name) END AS target_name,
       CASE WHEN c_nationkey = 3 THEN lower(c_mktsegment) ELSE c_mktsegment END AS schema, c_name AS name FROM customer""")

# --- filters -------------------------------------------------------------------------------------------
FILTERS = {
    "contains": ("part", {"p_name": "RED"}, "contains(lower(p_name), 'red')"),
    "contains_accents": ("documents", {"text": "ÉAU"}, "contains(lower(text), 'éau')"),
    "not_contains": ("part", {"p_name": "!red"}, "NOT contains(lower(p_name), 'red')"),
    "equals": ("customer", {"c_mktsegment": "=HOUSEHOLD"}, "c_mktsegment = 'HOUSEHOLD'"),
    "equals_is_case_sensitive": ("customer", {"c_mktsegment": "=household"}, "c_mktsegment = 'household'"),
    "equals_number_text": ("lineitem", {"l_quantity": "=10"}, "l_quantity = 10"),
    "equals_integer": ("orders", {"o_custkey": "=17"}, "o_custkey = 17"),
    "not_equals": ("orders", {"o_orderstatus": "!=F"}, "o_orderstatus <> 'F'"),
    "greater": ("orders", {"o_totalprice": ">400000.5"}, "o_totalprice > 400000.5"),
    "at_least": ("orders", {"o_custkey": ">=1400"}, "o_custkey >= 1400"),
    "less": ("part", {"p_size": "<5"}, "p_size < 5"),
    "at_most": ("lineitem", {"l_discount": "<=0.02"}, "l_discount <= 0.02"),
    "day_at_most": ("orders", {"o_orderdate": "<=1997-01-01"}, "CAST(o_orderdate AS DATE) <= DATE '1997-01-01'"),
    "day_greater": ("events", {"ts": ">2024-01-20"}, "CAST(ts AS DATE) > DATE '2024-01-20'"),
    "day_impossible": ("orders", {"o_orderdate": ">=1997-02-30"}, "left(CAST(o_orderdate AS VARCHAR), 10) >= '1997-02-30'"),
    "day_on_number": ("orders", {"o_custkey": "<=1997-01-01"}, "false"),
    "text_order": ("orders", {"o_orderpriority": ">=3-M"}, "o_orderpriority >= '3-M'"),
    "literal_escape": ("pages", {"html": "\\<p>"}, "contains(lower(html), '<p>')"),
    "all_of": ("lineitem", {"l_returnflag": "=R", "l_quantity": ">45", "l_shipdate": ">=1999-01-01", "l_tax": "  "},
               "l_returnflag = 'R' AND l_quantity > 45 AND l_shipdate >= DATE '1999-01-01'"),
}
for _name, (_table, _boxes, _where) in FILTERS.items():
    _text = ", ".join(c for c, _ in columns_of(_table))
    register(f"filter_{_name}", lambda t, n=_table, b=_boxes: filters.filter_rows(getattr(t, n), b), f"SELECT {_text} FROM {_table} WHERE {_where}")

_GAPS = "SELECT event_id, nullif(event_type, 'view') AS kind, CASE WHEN event_type = 'click' THEN NULL WHEN event_type = 'error' THEN '  ' ELSE CAST(value AS {S}) END AS cell FROM {events}"
_GAPS_DUCK = "(" + _GAPS.replace("{S}", "VARCHAR").replace("{events}", "events") + ")"
for _name, _boxes, _where in (
    ("empty", {"cell": "="}, "coalesce(trim(cell), '') = ''"), ("not_empty", {"cell": "!="}, "coalesce(trim(cell), '') <> ''"),
    ("not_equals_keeps_nulls", {"kind": "!=click"}, "coalesce(kind, '') <> 'click'"), ("not_contains_keeps_nulls", {"kind": "!IC"}, "NOT contains(lower(coalesce(kind, '')), 'ic')"),
    ("number_in_text", {"cell": ">100"}, "try_cast(trim(cell) AS DOUBLE) > 100"), ("text_order_skips_empty", {"cell": "<a"}, "trim(coalesce(cell, '')) <> '' AND cell < 'a'"),
):
    register(f"filter_{_name}", lambda t, b=_boxes: filters.filter_rows(t.sql(_GAPS.replace("{S}", "STRING"), "events"), b), f"SELECT event_id, kind, cell FROM {_GAPS_DUCK} WHERE {_where}")

register("filter_match_count", lambda t: filters.match_count(t.lineitem, {"l_returnflag": "=A", "l_quantity": ">=25"}),
         "SELECT count(*) AS match_count FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 25")
register("filter_first_matches", lambda t: filters.first_matches(t.orders, {"o_orderstatus": "=F"}, 50, ["o_orderkey"]),
         "SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
register("filter_numbered_page", lambda t: filters.numbered(filters.first_matches(t.events, {"event_type": "=click"}, 50, ["event_id"]).select("event_id", "value"), ["event_id"]),
         "SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS row_number FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50)")
register("filter_from_cells", lambda t: filters.filters_for_cells(t.conversations.select("conv_id", "role", "text")),
         """SELECT '=' || conv_id AS conv_id, '=' || role AS role, CASE WHEN regexp_matches(text, '[\\r\\n]') OR length(text) >= 1000 OR (trim(text) <> '' AND regexp_matches(text, '\\s$')) THEN NULL ELSE '=' || text END AS text FROM conversations""")
register("filter_view", lambda t: (t.sql("SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM {orders} GROUP BY o_custkey", "orders").createOrReplaceTempView("order_totals"),
                                   filters.filter_rows(t.spark.table("order_totals"), {"n": ">=15"}).selectExpr("o_custkey", "n", "round(total, 2) AS total"))[1],
         "SELECT o_custkey, n, total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n >= 15")

# --- ranges --------------------------------------------------------------------------------------------

def _range_sql(cells: str) -> str:
    return f"""SELECT count(*) AS cells, CASE WHEN ok THEN round(sum(x), 2) END AS sum, CASE WHEN ok THEN round(avg(x), 4) END AS avg, CASE WHEN ok THEN min(x) END AS min, CASE WHEN ok THEN max(x) END AS max
        FROM (SELECT x, bool_and(t = '' OR x IS NOT NULL) OVER () AS ok FROM (SELECT t, try_cast(nullif(t, '') AS DOUBLE) AS x FROM ({cells}))) GROUP BY ok"""


def _range(df):
    return df.selectExpr("cells", "round(sum, 2) AS sum", "round(avg, 4) AS avg", "min", "max")


register("range_whole_columns", lambda t: _range(ranges.range_summary(t.orders, [Range.cols(0, 0), Range.cols(2, 2)], "o_orderkey")),
         _range_sql("SELECT CAST(o_custkey AS VARCHAR) AS t FROM orders UNION ALL SELECT CAST(o_totalprice AS VARCHAR) FROM orders"))
register("range_overlap_counts_once", lambda t: _range(ranges.range_summary(t.orders, [Range.cells((100, 0), (900, 1)), Range.rows(500, 1200), Range.cols(0, 0)], "o_orderkey")),
         """SELECT count(*) AS cells, NULL AS sum, NULL AS avg, NULL AS min, NULL AS max FROM (
            SELECT o_orderkey AS r, 0 AS c FROM orders UNION SELECT o_orderkey, c FROM orders, range(2) AS t(c) WHERE o_orderkey BETWEEN 100 AND 900
            UNION SELECT o_orderkey, c FROM orders, range(5) AS t(c) WHERE o_orderkey BETWEEN 500 AND 1200)""")
register("range_label", lambda t: ranges.range_summary(t.part, [Range.cols(3, 3)], "p_partkey").select("cells", "label"),
         """SELECT cells, 'n = ' || format('{:,}', cells) || ', total ' || format('{:,}', s) || ', mean ' || CASE WHEN a = floor(a) THEN format('{:,}', CAST(a AS BIGINT)) ELSE format('{:.6g}', a) END || ', from ' || lo || ' to ' || hi AS label
            FROM (SELECT count(*) AS cells, CAST(sum(p_size) AS BIGINT) AS s, avg(CAST(p_size AS DOUBLE)) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part)""")
register("range_as_tsv", lambda t: ranges.tsv_lines(t.conversations.selectExpr("conv_id * 1000 + turn AS id", "role", "text"), [Range.cols(0, 1), Range(1000, 20000, 0, 0)], "id", header=True),
         """SELECT 0 AS block, NULL AS row_id, 'role' || chr(9) || 'text' AS line
            UNION ALL SELECT 0, conv_id * 1000 + turn, role || chr(9) || CASE WHEN regexp_matches(text, '[\\t\\r\\n"]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END FROM conversations
            UNION ALL SELECT 1, conv_id * 1000 + turn, role FROM conversations WHERE conv_id * 1000 + turn BETWEEN 1000 AND 20000""")

# --- manifests, derived from the part table: one manifest per part ----------------------------------------
_MANIFESTS = """SELECT to_json(named_struct('nodes', map(concat('model.', p_partkey), named_struct(
        'resource_type', CASE p_type WHEN 'ECONOMY' THEN 'test' WHEN 'PROMO' THEN 'seed' ELSE 'model' END, 'name', replace(p_name, ' ', '_'),
        'package_name', IF(p_size < 10, 'core', 'shop'), 'original_file_path', concat('models\\\\', p_brand, '\\\\p', CAST(p_partkey DIV 2 AS STRING), '.sql'),
        'database', CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN 'Lake' ELSE 'other' END, 'schema', upper(p_brand), 'alias', concat('T', CAST(p_partkey DIV 2 AS STRING)),
        'config', named_struct('materialized', IF(p_type = 'SMALL', 'ephemeral', 'table')),
        'columns', map('p_size', named_struct('description', concat('  Size of ', p_name, ' ')), 'blank', named_struct('description', '  '))))) ) AS manifest FROM {part}"""
_NODES = """(SELECT 'model.' || p_partkey AS node_id, CASE p_type WHEN 'ECONOMY' THEN 'test' WHEN 'PROMO' THEN 'seed' ELSE 'model' END AS resource_type, replace(p_name, ' ', '_') AS name,
    CASE WHEN p_size < 10 THEN 'core' ELSE 'shop' END AS package_name, 'models/' || p_brand || '/p' || (p_partkey // 2) || '.sql' AS original_file_path,
    CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN 'Lake' ELSE 'other' END AS "database", upper(p_brand) AS schema, 'T' || (p_partkey // 2) AS relation,
    CASE WHEN p_type = 'SMALL' THEN 'ephemeral' ELSE 'table' END AS materialized, p_name,
    CASE WHEN p_type <> 'ECONOMY' THEN lower(p_brand) || '.t' || (p_partkey // 2) END AS relation_key FROM part)"""


def _nodes(t: Tables):
    return dbt.manifest_relations(dbt.parse_manifest(t.sql(_MANIFESTS, "part")))


def _model_files(t: Tables):
    return t.sql("SELECT DISTINCT concat('models/', p_brand, '/p', CAST(p_partkey DIV 2 AS STRING), IF(p_size = 7, '.yml', '.sql')) AS path FROM {part}", "part")


def _built_tables(t: Tables):
    return t.sql("SELECT DISTINCT lower(p_brand) AS schema, concat('t', CAST(p_partkey DIV 2 AS STRING)) AS name FROM {part} WHERE p_retailprice > 950", "part")


_FILES = "(SELECT DISTINCT 'models/' || p_brand || '/p' || (p_partkey // 2) || CASE WHEN p_size = 7 THEN '.yml' ELSE '.sql' END AS path FROM part)"
_BUILT = "(SELECT DISTINCT lower(p_brand) AS schema, 't' || (p_partkey // 2) AS name FROM part WHERE p_retailprice > 950)"
_BY_FILE = f"(SELECT path, arg_min(n, node_id) AS n FROM (SELECT f.path, n.node_id, n FROM {_FILES} f JOIN {_NODES} n ON n.original_file_path = f.path AND n.package_name = 'shop') GROUP BY path)"
register("manifest_relations", lambda t: _nodes(t).drop("columns"),
         f'SELECT node_id, resource_type, name, package_name, "database", schema, relation, materialized, original_file_path, relation_key FROM {_NODES}')
register("manifest_descriptions", lambda t: dbt.column_descriptions(_nodes(t)),
         f"SELECT node_id, relation_key, 'p_size' AS \"column\", 'Size of ' || p_name AS description FROM {_NODES}")
register("manifest_node_for_file", lambda t: dbt.node_for_file(_model_files(t), _nodes(t), "shop"),
         f"SELECT path, n.node_id AS node_id, n.resource_type AS resource_type, n.name AS name, n.schema AS schema, n.relation AS relation, n.materialized AS materialized FROM {_BY_FILE}")
register("manifest_node_for_table", lambda t: dbt.node_for_table(_built_tables(t), _nodes(t), "lake", "shop"),
         f"""SELECT schema, name, n.node_id AS node_id, n.package_name AS package_name, n.relation_key AS relation_key FROM (
             SELECT schema, name, arg_min(n, (CASE WHEN n.package_name = 'shop' THEN '0' ELSE '1' END) || n.node_id) AS n
             FROM (SELECT b.schema, b.name, n FROM {_BUILT} b JOIN {_NODES} n ON n.relation_key = b.schema || '.' || b.name WHERE n."database" IS NULL OR lower(n."database") = 'lake') GROUP BY ALL)""")
register("manifest_preview_outcomes", lambda t: dbt.preview_outcomes(_model_files(t), _nodes(t), _built_tables(t), "shop"),
         f"""SELECT f.path, n.schema AS schema, n.relation AS relation, CASE WHEN NOT ends_with(f.path, '.sql') THEN 'not-sql' WHEN n.node_id IS NULL OR n.resource_type NOT IN ('model', 'seed', 'snapshot') OR n.materialized = 'ephemeral'
             THEN 'not-a-model' WHEN b.name IS NULL THEN 'missing-table' ELSE 'shown' END AS outcome FROM {_FILES} f LEFT JOIN {_BY_FILE} m ON m.path = f.path
             LEFT JOIN {_BUILT} b ON b.schema = lower(n.schema) AND b.name = lower(n.relation)""")


def _described(t: Tables):
    """The part table as if it were each of two relations: both have columns of these names, one of them in capitals."""
    described = dbt.column_descriptions(_nodes(t)).selectExpr("node_id", "CASE WHEN node_id < 'model.2' THEN 'shop.part' ELSE 'SHOP.OTHER' END AS relation_key", "upper(column) AS column", "description")
    sides = [dbt.with_descriptions(profile(t.part), described, key).withColumn("relation", F.lit(key)) for key in ("Shop.Part", "shop.other")]
    return sides[0].union(sides[1])


_PART_KINDS = {"bigint": "integer", "int": "integer", "double": "float", "string": "text"}
_DESCRIBED = " UNION ALL ".join(
    f"""SELECT '{key}' AS relation, {i} AS ordinal, '{c}' AS "column", '{_PART_KINDS[k]}' AS kind, count(DISTINCT {c}) AS "distinct",
        {f"'Size of ' || arg_min(p_name, 'model.' || p_partkey) FILTER (('model.' || p_partkey < 'model.2') = {first})" if c == 'p_size' else 'NULL'} AS description FROM part"""
    for key, first in (("Shop.Part", "true"), ("shop.other", "false")) for i, (c, k) in enumerate(columns_of("part")))
register("profile_with_descriptions", lambda t: _described(t).select("relation", "ordinal", "column", "kind", "distinct", "description"), _DESCRIBED)
register("description_coverage", lambda t: dbt.coverage(_described(t)),
         f"SELECT count(*) AS columns, count(description) AS described, count(*) - count(description) AS undescribed FROM ({_DESCRIBED})")

# --- refresh -------------------------------------------------------------------------------------------
_LOG = "SELECT IF(o_custkey % 9 = 0, NULL, concat('t', CAST(o_custkey AS STRING))) AS relation, timestampadd(SECOND, o_orderkey, CAST(o_orderdate AS TIMESTAMP)) AS at, CAST(o_totalprice AS BIGINT) AS rows FROM {orders}"
register("snapshot_deltas", lambda t: snapshots.snapshot_deltas(t.sql(_LOG, "orders")).selectExpr("relation", "CAST(at AS STRING) AS at", "previous_rows", "rows", "delta", "summary"),
         """SELECT relation, CAST("at" AS VARCHAR) AS "at", p AS previous_rows, rows, rows - p AS delta, CASE WHEN rows = p THEN format('{:,}', rows) || ' rows as before'
              WHEN p IS NOT NULL THEN CASE WHEN rows > p THEN '+' ELSE '-' END || format('{:,}', abs(rows - p)) || ' rows (' || format('{:,}', p) || ' to ' || format('{:,}', rows) || ')' END AS summary
            FROM (SELECT *, lag(rows) OVER (PARTITION BY relation ORDER BY "at") AS p FROM (
              SELECT CASE WHEN o_custkey % 9 <> 0 THEN 't' || o_custkey END AS relation, o_orderdate + to_seconds(o_orderkey) AS "at", CAST(trunc(o_totalprice) AS BIGINT) AS rows FROM orders))""")
_ISLANDS = """(SELECT user_id, us, sum(opening) OVER (PARTITION BY user_id ORDER BY us) AS burst FROM (
    SELECT user_id, us, CASE WHEN us <= lag(us) OVER (PARTITION BY user_id ORDER BY us) + 3600000000 THEN 0 ELSE 1 END AS opening FROM (SELECT user_id, epoch_us(ts) AS us FROM events)))"""
register("bursts_of_events", lambda t: refresh.bursts(t.events, "user_id", "ts", 3600).selectExpr("user_id", "unix_micros(burst_start) AS first_us", "unix_micros(last_event) AS last_us", "events"),
         f"SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM {_ISLANDS} GROUP BY user_id, burst")

def _events_stream(t: Tables):
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _streamed(t: Tables, stream):
    path = runtime.scratch_path(t.spark, "stream")
    refresh.to_table(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/table")


register("stream_filtered", lambda t: _streamed(t, refresh.filtered_stream(_events_stream(t), {"event_type": "!click", "value": ">100"})),
         "SELECT * FROM events WHERE NOT contains(event_type, 'click') AND value > 100")


def _closed_stream(t: Tables):
    """The events in order of time, three files of them, then one late event that closes the last bursts."""
    path = runtime.scratch_path(t.spark, "events")
    plain = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = plain.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 3
    for i in range(3):
        part = plain.where((F.col("ts") >= F.lit(low + i * step)) & ((F.col("ts") < F.lit(low + (i + 1) * step)) if i < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    closing = plain.limit(1).select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), F.lit(high + timedelta(days=2)).alias("ts"),
                                    F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    closing.coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(path)


register("stream_bursts", lambda t: _streamed(t, refresh.bursts(_closed_stream(t), "user_id", "ts", 3600)).selectExpr("user_id", "unix_micros(burst_start) AS first_us", "unix_micros(last_event) AS last_us", "events"),
         f"SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM {_ISLANDS} GROUP BY user_id, burst")


def _followed(t: Tables):
    """The profile after every batch of the stream."""
    seen = []
    path = runtime.scratch_path(t.spark, "follow")
    refresh.follow(_closed_stream(t), path, {"event_type": "=click"}, lambda n, so_far, p: seen.append(p.withColumn("batch", F.lit(n)))).awaitTermination()
    return reduce(DataFrame.union, seen[:3]).select("batch", "ordinal", "column", "rows", "distinct")


_THIRDS = "SELECT *, least(2, CAST(floor(3 * (epoch_us(ts) - lo) / (hi - lo)) AS INT)) AS third FROM events, (SELECT min(epoch_us(ts))::DOUBLE AS lo, max(epoch_us(ts))::DOUBLE AS hi FROM events)"
register("stream_reprofiled", _followed, " UNION ALL ".join(
    f"SELECT {n} AS batch, {i} AS ordinal, '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS \"distinct\" FROM ({_THIRDS}) WHERE event_type = 'click' AND third <= {n}"
    for n in range(3) for i, c in enumerate(["event_id", "user_id", "ts", "event_type", "value"])))


def _state_facts(merged: DataFrame, whole: DataFrame) -> DataFrame:
    """A profile from states, its estimates compared with the exact profile of the whole table."""
    exact = profile(whole).selectExpr("ordinal", "`distinct` AS d", "histogram AS h")
    off = "aggregate(zip_with(histogram.counts, h.counts, (a, b) -> abs(a - b)), 0L, (s, x) -> greatest(s, x))"
    return merged.join(exact, "ordinal").selectExpr(
        "ordinal", "column", "kind", "rows", "nulls", "min", "max", "round(mean, 4) AS mean", "abs(`distinct` - d) <= 0.07 * d + 1 AS distinct_is_close",
        f"coalesce({off} <= 0.04 * rows + 1, h IS NULL AND histogram IS NULL) AS histogram_is_close")


def _merged_states(t: Tables):
    """States of the parts by line number, each made of its own rows, then merged."""
    lineitem = t.lineitem
    kept = runtime.materialize(states.states_of(lineitem, "l_linenumber"), "states")
    return _state_facts(states.profile_of(states.merge_states(kept, lineitem.schema), lineitem.schema), lineitem)


def _state_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return f"SELECT ordinal, \"column\", kind, rows, nulls, min, max, mean, true AS distinct_is_close, true AS histogram_is_close FROM ({profile_sql(source, columns)})"


register("profile_states_merged", _merged_states, _state_sql("lineitem", columns_of("lineitem")))


def _followed_states(t: Tables):
    """The last of the profiles that a stream of the events leaves, batch by batch."""
    seen = []
    path = runtime.scratch_path(t.spark, "follow")
    refresh.follow_states(_closed_stream(t), path, {"event_type": "!=error"}, lambda n, so_far, p: seen.append((so_far, p))).awaitTermination()
    return _state_facts(seen[-1][1], seen[-1][0])


_STATE_COLUMNS = [("event_id", "bigint"), ("user_id", "bigint"), ("ts", "ntz"), ("event_type", "string"), ("value", "double")]
register("stream_reprofiled_by_states", _followed_states, _state_sql(
    """(SELECT event_id, user_id, ts, event_type, value FROM events WHERE event_type <> 'error' UNION ALL SELECT NULL, NULL, max(ts) + INTERVAL 2 DAY, NULL, NULL FROM events)""", _STATE_COLUMNS))


def _quartile_ranks(df: DataFrame, found: DataFrame, slack: float):
    """Whether each quartile of ``column, q25, q50, q75`` stands within ``slack`` of its rank, over all rows: between the shares of values below it and up to it."""
    names = [f.name for f in df.schema if kinds.is_numeric(f.dataType)]
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in names)
    cells = df.selectExpr(f"stack({len(names)}, {pairs}) AS (column, x)")
    ranks = cells.join(F.broadcast(found), "column").groupBy("column").agg(*[
        F.avg(F.expr(f"IF(x {sign} q{n}, 1D, 0D)")).alias(f"{name}{n}") for n in (25, 50, 75) for name, sign in (("under", "<"), ("upto", "<="))])
    return ranks.selectExpr("column", *[f"under{n} - {slack} <= {n} / 100 AND {n} / 100 <= upto{n} + {slack} AS q{n}_in_bounds" for n in (25, 50, 75)])


_IN_BOUNDS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", true AS q25_in_bounds, true AS q50_in_bounds, true AS q75_in_bounds" for c, k in columns_of("lineitem") if k in ("bigint", "int", "double"))
register("quartiles_from_states", lambda t: _quartile_ranks(t.lineitem, states.quartiles_of(states.states_of(t.lineitem), t.lineitem.schema), 0.02), _IN_BOUNDS)
register("summarize_quartile_ranks", lambda t: _quartile_ranks(t.lineitem, summarize(t.lineitem).where("q50 IS NOT NULL").selectExpr("column_name AS column", "q25", "q50", "q75"), 0.001), _IN_BOUNDS)
register("summarize_distinct_counts", lambda t: summarize(t.lineitem).join(profile(t.lineitem).selectExpr("column AS column_name", "`distinct` AS exact"), "column_name").selectExpr(
    "column_name", "`count`", "exact", "abs(approx_unique - exact) <= 0.15 * exact + 1 AS estimate_is_close"),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS \"count\", count(DISTINCT {c}) AS exact, true AS estimate_is_close FROM lineitem" for c, _ in columns_of("lineitem")))
