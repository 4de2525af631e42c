"""Page triage, admission and the status of a conversion: ordered cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.legacy import best_decoding
from ..functions.text import untrusted

#: Page classes, and bounds for scans and tables.
SCANNED, LEGACY, TABLES, DIGITAL = "SCANNED", "LEGACY_TEXT", "TABLE_HEAVY", "DIGITAL_TEXT"
FULL_PAGE, SLIVER, FILL, COLUMNS = 0.70, 150, 0.70, 2


def page_class(text: Column, image_share: Column, n_tables: Column) -> Column:
    """First rule that holds; the text is taken without white space at its ends."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^\\s+|\\s+$", "")
    can_decode = best_decoding(bare)["encoding"].isNotNull()
    return (
        F.when((bare == "") | ((image_share >= FULL_PAGE) & (F.length(bare) < SLIVER)), F.lit(SCANNED))
        .when(untrusted(bare), F.when(can_decode, F.lit(LEGACY)).otherwise(F.lit(SCANNED)))
        .when(n_tables > 0, F.lit(TABLES))
        .when(can_decode, F.lit(LEGACY))
        .otherwise(F.lit(DIGITAL))
    )


def image_share(images: Column, width: Column, height: Column) -> Column:
    """Largest share of the page that one of the images (w, h) covers."""
    return F.coalesce(F.array_max(F.transform(images, lambda r: r["w"] * r["h"] / (width * height))), F.lit(0.0))


def accepted_tables(cells: DataFrame) -> DataFrame:
    """Tables, from cells (table_id, row, col, text), with enough columns and filled cells."""
    filled = F.count_if(F.coalesce(F.trim("text"), F.lit("")) != "")
    sums = cells.groupBy("table_id").agg((filled / F.count(F.lit(1))).alias("fill"), (F.max("col") - F.min("col") + 1).alias("n_columns"))
    return sums.where((F.col("fill") >= FILL) & (F.col("n_columns") >= COLUMNS))


def admission(name: Column, size: Column, is_pdf: Column, locked: Column, scanned: Column, has_key: Column, within_quota: Column, most_bytes: int) -> Column:
    """(status_code, reason) of the first check that fails; 202 if none does. The quota is charged last."""
    no = lambda code, why: F.struct(F.lit(code).alias("status_code"), F.lit(why).alias("reason"))
    return (
        F.when(~F.lower(F.coalesce(name, F.lit(""))).endswith(".pdf"), no(400, "not a pdf name"))
        .when(size > most_bytes, no(413, "too large"))
        .when(~is_pdf, no(400, "not a pdf"))
        .when(locked, no(422, "needs a password"))
        .when(scanned & ~has_key, no(422, "scanned pages need a key"))
        .when(~within_quota, no(429, "quota used up"))
        .otherwise(no(202, "admitted"))
    )


def coverage(out_chars: Column, in_chars: Column) -> Column:
    return F.when(in_chars == 0, F.when(out_chars > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), out_chars / in_chars))


#: Bounds of the status rules.
LEAST_COVERAGE, LEAST_FIDELITY, LEAST_CONFIDENCE, MOST_DEGRADED = 0.60, 0.99, 0.8, 0.30


def conversion_status(rejected_tables: Column, fidelity: Column, n_blocks: Column, out_chars: Column, confidence: Column, cover: Column, n_degraded: Column, n_pages: Column, first_degraded: Column) -> Column:
    """(status, confidence). Later rules overwrite earlier ones; degraded pages even a failure."""
    done, warned, failed = F.lit("completed"), F.lit("completed_with_warnings"), F.lit("failed")
    status = F.when((rejected_tables > 0) | (F.coalesce(fidelity, F.lit(1.0)) < LEAST_FIDELITY), warned).otherwise(done)
    nothing = (n_blocks == 0) | (out_chars == 0)
    score = F.when(nothing, F.lit(0.0)).otherwise(F.bround(F.least(confidence, cover), 3))
    status = F.when(nothing, failed).when(cover < LEAST_COVERAGE, warned).otherwise(status)
    ratio = n_degraded / F.greatest(n_pages, F.lit(1))
    status = F.when(n_degraded > 0, F.when((ratio > MOST_DEGRADED) | first_degraded, failed).otherwise(warned)).otherwise(status)
    status = F.when((status != "failed") & (score < LEAST_CONFIDENCE), warned).otherwise(status)
    return F.struct(status.alias("status"), score.alias("confidence"))
