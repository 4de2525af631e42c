"""Inline rules of a paragraph's text: italic runs, list grids and cell spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: How a legal basis begins, and what the name of a law looks like.
BASIS = ("Căn cứ", "căn cứ", "Xét", "xét", "Theo đề nghị", "theo đề nghị", "Thực hiện", "thực hiện")
LAW = (
    r"(?U)(?:Luật|Pháp lệnh|Nghị định|Nghị quyết|Thông tư|Quyết định|Chỉ thị|Hiến pháp)(?:\s+(?:số\s+)?[\d\w/.\-]+)*"
    r"(?:\s+ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})?"
)


def runs(text: Column) -> Column:
    """Array of (text, italic): a line that begins with a legal basis is one italic run; else names of laws are italic."""
    run = lambda t, italic: F.struct(t.alias("text"), F.lit(italic).alias("italic"))
    names = F.regexp_extract_all(text, F.lit(LAW), 0)
    gaps = F.split(text, LAW, -1)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gaps) - 1), lambda i: F.array(run(F.get(gaps, i), False), run(F.coalesce(F.get(names, i), F.lit("")), True))))
    mixed = F.filter(pairs, lambda r: r["text"] != "")
    bare = F.regexp_replace(text, "(?U)^\\s+", "")
    none = F.array().cast("array<struct<text:string,italic:boolean>>")
    return F.when(F.trim(bare) == "", none).when(bare.rlike("^(?:" + "|".join(BASIS) + ")"), F.array(run(text, True))).otherwise(mixed)


def first_line_indent(block_type: Column, align: Column, points: float = 36.0) -> Column:
    return F.when((block_type == "paragraph") & (align == "justify"), F.lit(points))


def grid_places(tables: DataFrame) -> DataFrame:
    """Row and column range of each cell of a table given as rows of (text, colspan, rowspan).

    One row per table: (table_id, rows array<array<struct<text, colspan, rowspan>>>). Cells
    are laid from the left into the first columns that no earlier row still occupies; what
    goes beyond the last row or column is cut off, and a cell without a column left isn't laid.

    The state of the fold is how many rows each column is still occupied for, so a row costs
    its cells times the columns, whatever the spans.
    """
    wide = lambda c: F.greatest(F.lit(1), F.coalesce(c["colspan"], F.lit(1)))
    high = lambda c: F.greatest(F.lit(1), F.coalesce(c["rowspan"], F.lit(1)))
    n_columns = F.coalesce(F.array_max(F.transform("rows", lambda r: F.aggregate(r, F.lit(0), lambda a, c: a + wide(c)))), F.lit(0))
    sized = tables.select("table_id", "rows", n_columns.alias("n"), F.size("rows").alias("m"))
    cell_type = "struct<r:int,c:int,r_end:int,c_end:int,text:string>"

    def lay(a: Column, c: Column) -> Column:
        """One cell: the first free column from the cursor on, if any."""
        free = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (j >= a["at"]) & (F.get(a["busy"], j) <= 0))
        at = F.get(free, F.lit(0))
        end = F.least(at + wide(c), F.col("n")) - 1
        last = F.least(a["r"] + high(c), F.col("m")) - 1
        busy = F.transform(a["busy"], lambda h, j: F.when((j >= at) & (j <= end), F.greatest(h, last - a["r"] + 1)).otherwise(h))
        laid = F.struct(a["r"].alias("r"), at.alias("c"), last.alias("r_end"), end.alias("c_end"), c["text"].alias("text")).cast(cell_type)
        beyond = F.struct(a["r"].alias("r"), F.col("n").alias("at"), a["busy"].alias("busy"), a["out"].alias("out"))
        return F.when(at.isNull(), beyond).otherwise(F.struct(a["r"].alias("r"), (at + wide(c)).alias("at"), busy.alias("busy"), F.concat(a["out"], F.array(laid)).alias("out")))

    def row(a: Column, cells: Column) -> Column:
        begun = F.struct(a["r"].alias("r"), F.lit(0).alias("at"), a["busy"].alias("busy"), F.array().cast(f"array<{cell_type}>").alias("out"))
        done = F.aggregate(cells, begun, lay)
        return let(done, lambda d: F.struct((d["r"] + 1).alias("r"), F.transform(d["busy"], lambda h: F.greatest(h - 1, F.lit(0))).alias("busy"), F.concat(a["rows"], F.array(d["out"])).alias("rows")))

    start = F.struct(F.lit(0).alias("r"), F.array_repeat(F.lit(0), F.col("n")).alias("busy"), F.array().cast(f"array<array<{cell_type}>>").alias("rows"))
    laid = sized.where("n > 0").select("table_id", F.explode(F.flatten(F.aggregate("rows", start, row)["rows"])).alias("x"))
    return laid.select("table_id", "x.*")
