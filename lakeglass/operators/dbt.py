"""Joins of table metadata with dbt manifests.

A manifest is read as rows: one per node or source. Any number of manifests may be read at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import runtime
from ..functions.text import literal, trim_blanks

# The resource types that are relations.
RELATION_TYPES = ("model", "seed", "snapshot", "source")
TABLE_TYPES = ("model", "seed", "snapshot")

_NODE = (
    "STRUCT<resource_type: STRING, name: STRING, package_name: STRING, original_file_path: STRING, `database`: STRING, "
    "`schema`: STRING, alias: STRING, identifier: STRING, config: STRUCT<materialized: STRING>, "
    "columns: MAP<STRING, STRUCT<description: STRING>>>"
)
MANIFEST_SCHEMA = f"nodes MAP<STRING, {_NODE}>, sources MAP<STRING, {_NODE}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as a table with one ``nodes`` and one ``sources`` map per file."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)


def parse_manifest(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Manifests held as JSON texts, one per row."""
    return manifests.selectExpr(f"from_json({column}, {literal(MANIFEST_SCHEMA)}) AS m").selectExpr("m.nodes", "m.sources")


def manifest_relations(manifest: DataFrame) -> DataFrame:
    """One row per node with a type, name and file; ``relation_key`` is set for actual relations."""
    relation = "coalesce(IF(n.resource_type = 'source', nullif(n.identifier, ''), nullif(n.alias, '')), n.name)"
    types = ", ".join(f"'{t}'" for t in RELATION_TYPES)
    return runtime.query(
        f"""
        WITH entries AS (SELECT explode_outer(nodes) AS (node_id, n) FROM {{manifest}}
                         UNION ALL SELECT explode_outer(sources) AS (node_id, n) FROM {{manifest}})
        SELECT node_id, resource_type, name, package_name, `database`, schema, relation, materialized, original_file_path, columns,
               IF(resource_type IN ({types}) AND schema <> '', concat_ws('.', lower(schema), lower(relation)), NULL) AS relation_key
        FROM (SELECT node_id, n.resource_type, n.name, nullif(n.package_name, '') AS package_name,
                     nullif(n.`database`, '') AS `database`, coalesce(n.schema, '') AS schema, {relation} AS relation,
                     nullif(n.config.materialized, '') AS materialized, replace(n.original_file_path, '\\\\', '/') AS original_file_path,
                     n.columns
              FROM entries WHERE n.resource_type <> '' AND n.name <> '' AND n.original_file_path <> '')""",
        manifest=manifest,
    )


def column_descriptions(nodes: DataFrame) -> DataFrame:
    """One row per described column: non-blank, trimmed, whole."""
    trimmed = trim_blanks("info.description")
    return runtime.query(
        f"""SELECT node_id, relation_key, column, description
            FROM (SELECT node_id, relation_key, column, {trimmed} AS description
                  FROM {{nodes}} LATERAL VIEW explode(columns) AS column, info)
            WHERE description <> ''""",
        nodes=nodes,
    )


def node_for_file(files: DataFrame, nodes: DataFrame, project: str | None = None) -> DataFrame:
    """The node of each ``path``; with a known project only that package's nodes count."""
    own = f"AND n.package_name = {literal(project)}" if project is not None else ""
    picked = "struct(n.node_id, n.resource_type, n.name, n.schema, n.relation, n.materialized)"
    return runtime.query(
        f"""SELECT path, best.* FROM (
                SELECT f.path, min_by({picked}, n.node_id) AS best
                FROM (SELECT DISTINCT path FROM {{files}}) AS f JOIN {{nodes}} AS n ON n.original_file_path = f.path {own}
                GROUP BY f.path)""",
        files=files, nodes=nodes,
    )


def node_for_table(tables: DataFrame, nodes: DataFrame, file_stem: str, project: str | None = None) -> DataFrame:
    """The node that describes each ``(schema, name)`` table of a database file.

    A node of another database is not this table; the project's own package comes first.
    """
    foreign = f"NOT coalesce(n.package_name = {literal(project)}, false)" if project is not None else "false"
    return runtime.query(
        f"""SELECT schema, name, best.* FROM (
                SELECT t.schema, t.name, min_by(struct(n.node_id, n.package_name, n.relation_key), struct({foreign}, n.node_id)) AS best
                FROM (SELECT DISTINCT schema, name FROM {{tables}}) AS t
                JOIN {{nodes}} AS n ON n.relation_key = concat_ws('.', lower(t.schema), lower(t.name))
                WHERE n.`database` IS NULL OR lower(n.`database`) = lower({literal(file_stem)})
                GROUP BY t.schema, t.name)""",
        tables=tables, nodes=nodes,
    )


def preview_outcomes(files: DataFrame, nodes: DataFrame, tables: DataFrame, project: str | None = None) -> DataFrame:
    """For every model file: is it a model, and is its table there? All files in one pass."""
    found = node_for_file(files, nodes, project)
    types = ", ".join(f"'{t}'" for t in TABLE_TYPES)
    return runtime.query(
        f"""
        SELECT f.path, n.schema, n.relation, CASE
            WHEN NOT endswith(lower(f.path), '.sql') THEN 'not-sql'
            WHEN n.node_id IS NULL OR n.resource_type NOT IN ({types}) OR coalesce(n.materialized = 'ephemeral', false) THEN 'not-a-model'
            WHEN t.k IS NULL THEN 'missing-table' ELSE 'shown' END AS outcome
        FROM (SELECT DISTINCT path FROM {{files}}) AS f LEFT JOIN {{found}} AS n ON n.path = f.path
        LEFT JOIN (SELECT DISTINCT concat_ws('.', lower(schema), lower(name)) AS k FROM {{tables}}) AS t
            ON t.k = concat_ws('.', lower(n.schema), lower(n.relation))""",
        files=files, found=found, tables=tables,
    )


def with_descriptions(profile: DataFrame, descriptions: DataFrame, relation_key: str) -> DataFrame:
    """A profile of one relation with the description of each column beside it.

    Only descriptions of that relation count, and names of relations and columns match in any case. Where several nodes describe
    the same column, the node with the smallest id speaks, so no column of the profile comes twice.
    """
    return runtime.query(
        f"""SELECT /*+ BROADCAST(d) */ p.*, d.description FROM {{profile}} AS p LEFT JOIN (
                SELECT lower(column) AS named, min_by(description, struct(node_id, column)) AS description
                FROM {{descriptions}} WHERE lower(relation_key) = lower({literal(relation_key)}) GROUP BY lower(column)) AS d
            ON d.named = lower(p.column) ORDER BY ordinal""",
        profile=profile, descriptions=descriptions,
    )


def coverage(described_profile: DataFrame) -> DataFrame:
    """How many profiled columns have a description."""
    return runtime.query(
        """SELECT count(*) AS columns, count_if(description IS NOT NULL) AS described,
                  count_if(description IS NULL) AS undescribed FROM {p}""",
        p=described_profile,
    )
