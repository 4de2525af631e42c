"""Block documents and job records as JSON, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = (
    "type string, confidence double, page int, bbox array<int>, text string, level int, align string, first_line_indent_pt double, "
    "runs array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>, ordered boolean, marker string, items array<struct<text:string>>, "
    "headers array<array<struct<text:string,colspan:int,rowspan:int,align:string,bold:boolean>>>, rows array<array<struct<text:string,colspan:int,rowspan:int,align:string,bold:boolean>>>, "
    "kind string, src string, placement string, anchor_block string, orientation string, page_size string, label string, `left` string, `right` string"
)
BROKEN = "_corrupt_record"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of {"blocks": [...]}: one row per block with its file and place."""
    docs = spark.read.schema(f"blocks array<struct<{_as_struct(BLOCK)}>>").option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("file"), F.posexplode("blocks").alias("seq", "block")).select("file", "seq", "block.*")


def _as_struct(schema: str) -> str:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = schema[start:i].strip().split(" ", 1)
            parts.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(parts)


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, broken) records of a folder of JSON lines; what can't be read is kept as text."""
    parsed = F.from_json("value", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", parsed.alias("r"))
    bad = F.col(f"r.{BROKEN}").isNotNull()
    return rows.where(~bad).select("r.*").drop(BROKEN), rows.where(bad).select(F.col("value").alias(BROKEN))


def unknown_keys(text: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that its type doesn't allow."""
    return F.array_except(F.json_object_keys(text), F.lit(allowed))


def write_state(rows: DataFrame, path: str, seconds: int) -> None:
    """Records with the time at which they expire."""
    rows.withColumn("expires_at", F.current_timestamp() + F.make_dt_interval(secs=F.lit(seconds))).write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Records that haven't expired; one that expires this very moment is still there."""
    return spark.read.parquet(path).where(F.col("expires_at") >= F.current_timestamp())


def write_blocks(blocks: DataFrame, path: str) -> None:
    """One JSON object per block, without nulls."""
    blocks.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
