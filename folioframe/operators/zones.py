"""Header and signature zones of an administrative page.

Lines are rows (doc_id, page, line_no, text, side, zone). A zone's fields are each filled by
the first line in reading order that matches; a line that matches a filled field is tried
against the fields after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, is_agency

#: What the fields of a header look like, in the order in which a line is tried against them.
HEADER_FIELDS = {
    "country_name": r"(?iu)CỘNG\s+H[OÒ]A",
    "motto": r"(?iu)Độc\s+lập",
    "location_and_date": r"\d{1,2}\s+th[áa]ng\s+\d{1,2}\s+năm\s+\d{4}",
    "document_number": r"(?iu)^S[ốô]\s*:",
}
AGENCIES = ("superior_agency", "issuing_agency")
#: Cues of a signature.
AUTHORITY, RECEIPT = r"^(?:TM\.|KT\.)\s", r"(?iu)^Nơi\s+nhận"
TITLE = (
    r"^(?:BỘ\s+TRƯỞNG|THỨ\s+TRƯỞNG|CHỦ\s+TỊCH|PHÓ\s+CHỦ\s+TỊCH|GIÁM\s+ĐỐC|PHÓ\s+GIÁM\s+ĐỐC|TỔNG\s+GIÁM\s+ĐỐC|CỤC\s+TRƯỞNG|PHÓ\s+CỤC\s+TRƯỞNG|"
    r"VỤ\s+TRƯỞNG|TRƯỞNG\s+BAN|HIỆU\s+TRƯỞNG|CHÁNH\s+VĂN\s+PHÒNG|GIÁM\s+ĐỐC\s+SỞ)"
)
NAME_CHARS = 40


def zone_lines(*zones: DataFrame) -> DataFrame:
    """The lines of several zones as one table."""
    out = zones[0]
    for more in zones[1:]:
        out = out.unionByName(more)
    return out


def header_fields(lines: DataFrame) -> DataFrame:
    """Lines of page 1's header zone with text t and the field each of them fills, if any.

    A line fills the first field, in their order, that it matches and no line before it
    filled. So the line of a field is the first match among the lines that earlier fields
    left: one window for each field, all over the same partitions.
    """
    own = lines.where("zone = 'header' AND page = 1").withColumn("t", collapse(F.col("text"))).where("t <> ''").withColumn("field", F.lit(None).cast("string"))
    doc = Window.partitionBy("doc_id")
    for name, pattern in HEADER_FIELDS.items():
        first = F.min(F.when(F.col("field").isNull() & F.col("t").rlike(pattern), F.col("line_no"))).over(doc)
        own = own.withColumn("__at", first).withColumn("field", F.when(F.col("field").isNull() & (F.col("line_no") == F.col("__at")), F.lit(name)).otherwise(F.col("field"))).drop("__at")
    agency = F.when(F.col("field").isNull() & is_agency(F.col("t")), F.lit(1)).otherwise(F.lit(0))
    own = own.withColumn("__agency", agency).withColumn("__n", F.sum("__agency").over(doc))
    own = own.withColumn("__place", F.sum("__agency").over(doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    stack = F.when((F.col("__place") == 1) & (F.col("__n") > 1), F.lit(AGENCIES[0])).when(F.col("__place") <= 2, F.lit(AGENCIES[1]))
    return own.withColumn("field", F.when(F.col("__agency") == 1, stack).otherwise(F.col("field"))).drop("__agency", "__n", "__place")


def header_blocks(lines: DataFrame) -> DataFrame:
    """At most one header per document, with the numbers of the lines it used."""
    fields = (*HEADER_FIELDS, *AGENCIES)
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("t"))).alias(f)
    used = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.col("line_no")))).alias("used")  # seven at most
    out = header_fields(lines).groupBy("doc_id").agg(*(value(f) for f in fields), used)
    complete = "country_name IS NOT NULL AND motto IS NOT NULL OR document_number IS NOT NULL AND coalesce(country_name, motto, location_and_date) IS NOT NULL"
    return out.where(complete)


def signature_cues(lines: DataFrame) -> DataFrame:
    """Per page: authority, title and name on the right of the signature zone, receipt label and list on its left, with the lines used.

    The name is the first short line left on the right, if there is an authority or title. With
    a label all lines on the left are receipts, else none. Pages with neither have no signature.
    """
    own = lines.where("zone = 'signature'").withColumn("t", collapse(F.col("text"))).where("t <> ''")
    right = F.col("side") == "right"
    page = Window.partitionBy("doc_id", "page")
    first = lambda test: F.min(F.when(test, F.col("line_no"))).over(page)
    label = ~right & F.col("t").rlike(RECEIPT)
    at = own.withColumn("a", first(right & F.col("t").rlike(AUTHORITY))).withColumn("l", first(label))
    at = at.withColumn("b", first(right & F.col("t").rlike(TITLE) & ~F.col("line_no").eqNullSafe(F.col("a"))))
    rest = right & ~F.col("line_no").eqNullSafe(F.col("a")) & ~F.col("line_no").eqNullSafe(F.col("b")) & (F.length("t") < NAME_CHARS)
    at = at.withColumn("n", F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), first(rest)))
    receipt = ~right & F.col("l").isNotNull()
    used = F.col("line_no").eqNullSafe(F.col("a")) | F.col("line_no").eqNullSafe(F.col("b")) | F.col("line_no").eqNullSafe(F.col("n")) | receipt
    field = lambda c: F.max(F.when(F.col("line_no") == F.col(c), F.col("t")))
    listed = F.array_sort(F.collect_list(F.when(receipt & ~label, F.struct("line_no", "t"))))
    out = at.groupBy("doc_id", "page").agg(
        field("a").alias("authority"),
        field("b").alias("title"),
        field("l").alias("receipt_label"),
        field("n").alias("name"),
        F.transform(listed, lambda x: x["t"]).alias("receipt_list"),
        F.array_sort(F.collect_list(F.when(used, F.col("line_no")))).alias("used"),
    )
    return out.where("coalesce(authority, title, receipt_label) IS NOT NULL")


def last_signature(signatures: DataFrame) -> DataFrame:
    """The signature of the last page that has one."""
    fields = [c for c in signatures.columns if c != "doc_id"]
    return signatures.groupBy("doc_id").agg(F.max_by(F.struct(*fields), "page").alias("s")).select("doc_id", "s.*")


def used_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, page, line_no of the lines that header (page 1) or signature blocks used."""
    page = F.col("page") if "page" in blocks.columns else F.lit(1)
    return blocks.select("doc_id", page.cast("long").alias("page"), F.explode("used").alias("line_no"))


def body_lines(lines: DataFrame, used: DataFrame) -> DataFrame:
    """All lines that no zone block used: what isn't recognised returns to the body."""
    taken = used.select("doc_id", F.lit(1).cast(lines.schema["page"].dataType).alias("page"), F.explode("used").alias("line_no"))
    return lines.join(taken, ["doc_id", "page", "line_no"], "left_anti")


def restored(lines: DataFrame, *used: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line_no, y, x0) that none of the zone blocks used, with their position in reading order."""
    keys = ["doc_id", "page", "line_no"]
    taken = used[0].select(*keys)
    for more in used[1:]:
        taken = taken.unionByName(more.select(*keys))
    w = Window.partitionBy("doc_id").orderBy("page", "y", "x0", "line_no")
    return lines.join(taken.distinct(), keys, "left_anti").withColumn("position", F.row_number().over(w))


def outside_tables(lines: DataFrame, tables: DataFrame, cell: float = 100.0) -> DataFrame:
    """Lines whose middle lies in no table of their page: lines and tables have x0, y, x1, y1.

    A table's box is named by the grid cells it touches, a line's middle by its one cell, so
    both meet by equal keys; the exact test follows. On a grid of 1000 a box has 121 cells at most.
    """
    of = lambda v: F.floor(v / cell)
    cells = tables.select("doc_id", "page", F.col("x0").alias("tx0"), F.col("y").alias("ty"), F.col("x1").alias("tx1"), F.col("y1").alias("ty1"))
    cells = cells.withColumn("cx", F.explode(F.sequence(of(F.col("tx0")), of(F.col("tx1"))))).withColumn("cy", F.explode(F.sequence(of(F.col("ty")), of(F.col("ty1")))))
    mid = lines.withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y") + F.col("y1")) / 2).withColumn("cx", of(F.col("mx"))).withColumn("cy", of(F.col("my")))
    l, t = mid.alias("l"), cells.alias("t")
    same = [F.col(f"l.{c}") == F.col(f"t.{c}") for c in ("doc_id", "page", "cx", "cy")]
    inside = F.col("mx").between(F.col("tx0"), F.col("tx1")) & F.col("my").between(F.col("ty"), F.col("ty1"))
    return l.join(t, same[0] & same[1] & same[2] & same[3] & inside, "left_anti").select(*lines.columns)


def in_table_order(tables: DataFrame) -> DataFrame:
    """Adds table_no: tables of a page by their tops, then left edges."""
    return tables.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x0")))


def slots(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds slot: how many tables of the page come before a line, never fewer than for the line before.

    A sweep down the page: tops of tables and middles of lines in one order, tops first, give
    each line the tops passed; a running maximum in the order of the lines follows.
    """
    null = lambda c: F.lit(None).cast(lines.schema[c].dataType).alias(c)
    tops = tables.select("doc_id", "page", F.col("y").cast("double").alias("__y"), F.lit(0).alias("__line"), *(null(c) for c in lines.columns if c not in ("doc_id", "page")))
    mids = lines.select("doc_id", "page", ((F.col("y") + F.col("y1")) / 2).cast("double").alias("__y"), F.lit(1).alias("__line"), *(c for c in lines.columns if c not in ("doc_id", "page")))
    page = Window.partitionBy("doc_id", "page")
    upto = (Window.unboundedPreceding, 0)
    passed = F.sum(1 - F.col("__line")).over(page.orderBy("__y", "__line").rowsBetween(*upto))
    out = tops.unionByName(mids).withColumn("__n", passed).where("__line = 1")
    return out.withColumn("slot", F.max("__n").over(page.orderBy("line_no").rowsBetween(*upto))).select(*lines.columns, "slot")


def two_columns(lines: DataFrame) -> DataFrame:
    """Adds column (left, right; lines over both are left) and two_columns: whether the page has lines on both sides."""
    mid = F.col("width") / 2
    side = F.when(F.col("x1") <= mid + 1, F.lit("left")).when(F.col("x0") >= mid - 1, F.lit("right")).otherwise(F.lit("left"))
    marked = lines.withColumn("column", side)
    return marked.withColumn("two_columns", F.size(F.collect_set("column").over(Window.partitionBy("doc_id", "page"))) == 2)


def distinct_cells(cells: DataFrame) -> DataFrame:
    """One cell for each box of a table, the first in row and column order."""
    w = Window.partitionBy("table_id", "bbox").orderBy("row", "col")
    return cells.withColumn("__n", F.row_number().over(w)).where("bbox IS NULL OR __n = 1").drop("__n")
