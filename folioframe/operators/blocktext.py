"""What a block says and how much of it counts, by its type.

Blocks are structs with type, text, items, headers, rows, left, right and label; fields
that a type doesn't use are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of the two columns of a header and of a signature, in the order in which they are read.
HEADER_LEFT, HEADER_RIGHT = ("superior_agency", "issuing_agency", "document_number"), ("country_name", "motto", "location_and_date")
SIGNED = ("authority", "title", "name")
NO_TEXTS = "array<string>"


def _fields(side: Column, names: tuple[str, ...]) -> list[Column]:
    return [side[n] for n in names]


def _cells(block: Column) -> Column:
    """Texts of a table's cells, headers first."""
    none = F.array().cast(NO_TEXTS)
    texts = lambda rows: F.coalesce(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda c: c["text"]))), none)
    return F.concat(texts(block["headers"]), texts(block["rows"]))


def _parts(block: Column) -> Column:
    """The texts a block is made of, whatever its type; null for types that have none."""
    kind, none = block["type"], F.array().cast(NO_TEXTS)
    header = F.array(*_fields(block["left"], HEADER_LEFT), *_fields(block["right"], HEADER_RIGHT))
    signature = F.concat(F.coalesce(block["left"]["receipt_list"], none), F.array(*_fields(block["right"], SIGNED)))
    return (
        F.when(kind.isin("heading", "paragraph"), F.array(block["text"]))
        .when(kind == "list", F.coalesce(F.transform(block["items"], lambda x: x["text"]), none))
        .when(kind == "table", _cells(block))
        .when(kind == "admin_header", header)
        .when(kind == "signature", signature)
    )


def block_text(block: Column) -> Column:
    """Plain text for comparisons: items, cells and fields in order, one space between; nothing for pictures."""
    parts = F.transform(_parts(block), lambda x: F.coalesce(x, F.lit("")))
    filled = F.when(block["type"].isin("admin_header", "signature"), F.filter(parts, lambda x: x != "")).otherwise(parts)
    return F.when(block["type"] == "section_break", F.coalesce(block["label"], F.lit(""))).otherwise(F.coalesce(F.array_join(filled, " "), F.lit("")))


def content_chars(block: Column) -> Column:
    """Characters that count as content: each part without white space at its ends; breaks and pictures have none."""
    bare = lambda x: F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)^\\s+|\\s+$", "")).cast("long")
    return F.coalesce(F.aggregate(_parts(block), F.lit(0).cast("long"), lambda n, x: n + bare(x)), F.lit(0).cast("long"))
