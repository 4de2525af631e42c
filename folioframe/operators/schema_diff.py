"""Comparing a catalog with what is required: tables as (table, name, nullable, has_default), keys as (kind, table, columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_columns(spark: SparkSession) -> DataFrame:
    """Columns of the session's tables and views, as they are now."""
    rows = [(t.name, c.name, c.nullable, False) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, name string, nullable boolean, has_default boolean")


def missing_columns(required: DataFrame, actual: DataFrame) -> DataFrame:
    return required.join(actual, ["table", "name"], "left_anti")


def blocking_columns(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns that nothing required knows and that can't be left out: not null and without a default."""
    tables = required.select("table").distinct()
    return actual.where(~F.col("nullable") & ~F.col("has_default")).join(tables, "table", "left_semi").join(required, ["table", "name"], "left_anti")


def missing_keys(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys by kind, table and the ordered array of columns."""
    return required.join(actual, ["kind", "table", "columns"], "left_anti")


def key_columns(members: DataFrame) -> DataFrame:
    """Ordered column arrays of keys, from (kind, table, key, place, name)."""
    listed = F.array_sort(F.collect_list(F.struct("place", "name")))
    return members.groupBy("kind", "table", "key").agg(F.transform(listed, lambda x: x["name"]).alias("columns"))


def index_columns(indexes: DataFrame, relations: DataFrame, spaces: DataFrame, attributes: DataFrame) -> DataFrame:
    """Names of the columns of indexes in key order.

    indexes (index, relation, key array), relations (relation, table, space), spaces (space,
    schema) and attributes (attribute, name): inner joins around the key's ordered unnest.
    """
    placed = indexes.join(relations, "relation").join(spaces, "space").select("schema", "table", "index", F.posexplode("key").alias("place", "attribute"))
    listed = F.array_sort(F.collect_list(F.struct("place", "name")))
    return placed.join(attributes, "attribute").groupBy("schema", "table", "index").agg(F.transform(listed, lambda x: x["name"]).alias("columns"))


def constraint_columns(heads: DataFrame, members: DataFrame, targets: DataFrame) -> DataFrame:
    """Own and referenced columns of constraints in order; the latter are null where nothing is referred to.

    heads (constraint, target), members (constraint, place, name, referenced_name), targets (target, referenced).
    """
    listed = F.array_sort(F.collect_list(F.struct("place", "name", "referenced_name")))
    arrays = members.groupBy("constraint").agg(listed.alias("m"))
    joined = heads.join(arrays, "constraint").join(targets, "target", "left")
    other = F.when(F.col("referenced").isNotNull(), F.transform("m", lambda x: x["referenced_name"]))
    return joined.select("constraint", F.transform("m", lambda x: x["name"]).alias("columns"), "referenced", other.alias("referenced_columns"))


def migration_state(n_applied: int, n_tables: int, problems: DataFrame) -> str:
    """What a database needs before migrations can run on it."""
    if n_applied:
        return "already-migrated"
    if not n_tables:
        return "fresh"
    return "compatible" if problems.isEmpty() else "incompatible"


def in_catalog_order(columns: DataFrame) -> DataFrame:
    """Columns (table, place, name) as a catalog lists them: by table, then by place."""
    return columns.orderBy("table", "place", "name")
