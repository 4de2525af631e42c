"""How blocks are set: a small dimension of styles, and render instructions as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "block_type string, field string, size_pt double, bold boolean, italic boolean, upper boolean, align string"
#: Letter size, bold, italic, capitals and alignment of each field of a block.
STYLES = [
    ("admin_header", "superior_agency", 12.0, False, False, True, "center"),
    ("admin_header", "issuing_agency", 13.0, True, False, True, "center"),
    ("admin_header", "document_number", 13.0, False, False, False, "center"),
    ("admin_header", "country_name", 12.5, True, False, True, "center"),
    ("admin_header", "motto", 13.5, True, False, False, "center"),
    ("admin_header", "location_and_date", 13.5, False, True, False, "center"),
    ("heading", "level_1", 14.0, True, False, True, "center"),
    ("heading", "level_2", 13.5, True, False, True, "left"),
    ("heading", "level_3", 13.5, True, False, True, "center"),
    ("paragraph", "text", 13.5, False, False, False, "justify"),
    ("list", "item", 13.5, False, False, False, None),
    ("table", "cell", 13.0, False, False, False, None),
    ("signature", "label", 13.5, True, True, False, None),
    ("signature", "receipt_item", 11.5, False, False, False, None),
    ("signature", "authority", 13.5, True, False, True, "center"),
    ("signature", "title", 13.5, True, False, True, "center"),
    ("signature", "name", 13.5, True, False, True, "center"),
    ("section_break", "label", 14.0, True, False, True, "center"),
]


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, SCHEMA)


def instructions(pieces: DataFrame) -> DataFrame:
    """Pieces of blocks (block_type, field, text, ...) with their style; those without one keep nulls.

    The text is set in capitals where its style asks for them.
    """
    styled = pieces.join(F.broadcast(dimension(pieces.sparkSession)), ["block_type", "field"], "left")  # one row a field: of fixed size
    return styled.withColumn("text", F.when(F.coalesce("upper", F.lit(False)), F.upper("text")).otherwise(F.col("text")))
