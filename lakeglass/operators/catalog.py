"""Listing, searching and resolving relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..functions.text import literal

# The schema whose tables keep their bare names, and schemas that are never listed.
DEFAULT_SCHEMA = "default"
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "sys")

RELATION_COLUMNS = "schema string, name string, type string, approx_rows bigint"
_STATISTICS = r"(?m)^Statistics: \d+ bytes, (\d+) rows$"


def session_relations(spark: SparkSession) -> DataFrame:
    """Tables and views of every schema of the session, from catalog metadata alone: one command per schema.

    Row counts are those of stored statistics; no table is scanned, and a relation without statistics has none.
    """
    schemas = [r[0] for r in spark.sql("SHOW SCHEMAS").collect() if r[0] not in SYSTEM_SCHEMAS]
    parts = []
    for schema in schemas:
        listed = spark.sql(f"SHOW TABLE EXTENDED IN `{schema.replace('`', '``')}` LIKE '*'")
        temporary = "true" if schema == DEFAULT_SCHEMA else "NOT isTemporary"  # every schema lists them
        parts.append(listed.where(temporary).selectExpr(
            f"{literal(schema)} AS schema", "tableName AS name", r"IF(isTemporary OR information RLIKE r'(?m)^Type: VIEW$', 'view', 'table') AS type",
            f"TRY_CAST(nullif(regexp_extract(information, r'{_STATISTICS}', 1), '') AS BIGINT) AS approx_rows"))
    return reduce(DataFrame.union, parts)


def relations(found: DataFrame, default_schema: str = DEFAULT_SCHEMA) -> DataFrame:
    """Catalog listing of ``(schema, name, type, approx_rows)`` rows with ids, default schema first."""
    main = F.col("schema") == default_schema
    return (
        found.where(~F.col("schema").isin(*SYSTEM_SCHEMAS))
        .withColumn("id", F.when(main, F.col("name")).otherwise(F.concat_ws(".", "schema", "name")))
        .orderBy((~main), "schema", "name")
    )


def search(found: DataFrame, text: str, default_schema: str = DEFAULT_SCHEMA) -> DataFrame:
    """Relations whose id contains a text, ignoring case, in catalog order; one row per relation.

    Rows carry their schema, so a viewer groups them without collecting a schema into one row.
    """
    listed = relations(found, default_schema)
    needle = F.lower(F.lit(text.strip()))
    return listed.where(F.contains(F.lower("id"), needle)).orderBy(F.col("schema") != default_schema, "schema", "name")


def search_counts(found: DataFrame, text: str, default_schema: str = DEFAULT_SCHEMA) -> DataFrame:
    """Matches per schema."""
    return search(found, text, default_schema).groupBy("schema").agg(F.count(F.lit(1)).alias("matches"))


def resolve(targets: DataFrame, found: DataFrame, default_schema: str = DEFAULT_SCHEMA) -> DataFrame:
    """The relation each ``(schema, name)`` target means: the exact one, else one that ignores case.

    The best candidate is kept by an aggregate, which combines on the map side, so a name with
    very many candidates never becomes one sorted group.
    """
    return runtime.query(
        f"""
        SELECT target_schema, target_name, best.schema AS schema, best.name AS name FROM (
            SELECT t.schema AS target_schema, t.name AS target_name,
                   min_by(struct(r.schema, r.name), struct(r.schema <> t.schema OR r.name <> t.name, r.schema, r.name)) AS best
            FROM (SELECT DISTINCT coalesce(schema, {literal(default_schema)}) AS schema, name FROM {{targets}}) AS t
            JOIN {{found}} AS r ON lower(r.schema) = lower(t.schema) AND lower(r.name) = lower(t.name)
            GROUP BY t.schema, t.name)""",
        targets=targets, found=found,
    )
