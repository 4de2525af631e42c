"""Readers for the table folder layout ``<dir>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; works on any path that Spark's own readers open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores, where the files give fewer partitions than that (a file of one row group is one task).

    With as many partitions as cores, as with any large table, nothing is moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
