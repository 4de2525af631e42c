"""Whole rows through Arrow tasks, whatever their other columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(docs: DataFrame, run) -> DataFrame:
    """``docs`` after ``run`` (batches to batches of the same columns), which finds doc_id and text by name."""
    plain = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    narrow = docs.toDF(*plain)
    return narrow.mapInArrow(run, narrow.schema).toDF(*docs.columns)
