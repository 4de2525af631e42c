"""What a vision service returned, against the pages it was asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: most confidence that a block read from a scan can have.
SCAN_CONFIDENCE = 0.95


def accepted_blocks(blocks: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of blocks (doc_id, batch, seq, page, confidence) against the asked pages (doc_id, batch, page).

    A block without a page belongs to the page of a batch of one, and is dropped from larger
    ones; a block of a page that its batch didn't ask for is dropped. Kept ones have their
    confidence capped. ``dropped`` has a reason.
    """
    sizes = asked.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n_asked"), F.min("page").alias("only_page"))
    paged = blocks.join(sizes, ["doc_id", "batch"]).withColumn("page", F.coalesce("page", F.when(F.col("n_asked") == 1, F.col("only_page")))).drop("n_asked", "only_page")
    wanted = asked.select("doc_id", "batch", "page")
    kept = paged.join(wanted, ["doc_id", "batch", "page"], "left_semi").withColumn("confidence", F.least("confidence", F.lit(SCAN_CONFIDENCE)))
    dropped = paged.join(wanted, ["doc_id", "batch", "page"], "left_anti").withColumn("reason", F.when(F.col("page").isNull(), F.lit("no page")).otherwise(F.lit("wrong page")))
    return kept.select(*blocks.columns), dropped.select(*blocks.columns, "reason")


def missing_pages(kept: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked pages for which nothing was kept: degraded ones."""
    return asked.join(kept, ["doc_id", "batch", "page"], "left_anti")
