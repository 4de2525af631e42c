"""Changes to tables, as DataFrames in and out: what a store would do by create, upsert, update and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key isn't there yet; what is there stays as it is."""
    return table.unionByName(rows.join(table, keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of their key, or are added. A null in a new row is a value."""
    return table.join(rows, keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_of, keys, "left_anti").select(*table.columns)


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Sets columns where the condition holds; where it is null nothing changes."""
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def the_only(table: DataFrame, condition: Column) -> DataFrame:
    """The one row that fits; an error if there are none or several."""
    found = table.where(condition)
    n = len(found.head(2))
    if n != 1:
        raise ValueError("no row fits" if n == 0 else "several rows fit")
    return found
