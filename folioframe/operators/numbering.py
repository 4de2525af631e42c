"""Row numbers of keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place of a row among the rows of its key, from 0, in the order; keys aren't null.

    The rows are sorted in ranges of key and order, so that a key with very many rows lies in
    several tasks; what a key has in the ranges before is added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(c) for c in (*keys, *order)]
    placed = rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered")
    parts = placed.groupBy(*keys, "__part").agg(F.min("__row").alias("__from"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before).drop("__n")
    return placed.join(parts, [*keys, "__part"]).withColumn(name, F.col("__before") + F.col("__row") - F.col("__from")).drop("__part", "__row", "__from", "__before")
