"""Checks of block JSON against the nine block types, compiled to expressions over VARIANT.

``checked`` gives one row per chunk with at most ten errors, each naming the path of what is
wrong, in the order of blocks and of their types' fields; unknown keys of an object come last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Errors of a chunk that are kept: what goes back with a retry stays short.
MOST_ERRORS = 10
Check = Callable[[Column, Column], Column]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _errors(*tests: tuple[Column, Column]) -> Column:
    """Messages of the tests that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), message) for test, message in tests)))


def _said(loc: Column, message: str) -> Column:
    return F.concat(loc, F.lit(f": {message}"))


def text(v: Column, loc: Column) -> Column:
    return _errors((_kind(v) != "STRING", _said(loc, "Input should be a valid string")))


def boolean(v: Column, loc: Column) -> Column:
    return _errors((_kind(v) != "BOOLEAN", _said(loc, "Input should be a valid boolean")))


def number(low: float | None = None, high: float | None = None, whole: bool = False) -> Check:
    """A number, a whole one, within bounds; bounds are named as they are written."""

    def check(v: Column, loc: Column) -> Column:
        value = F.try_variant_get(v, "$", "double")
        good = _kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if whole:
            good = good & (value == F.floor(value))
        tests = [(~good, _said(loc, f"Input should be a valid {'integer' if whole else 'number'}"))]
        if low is not None:
            tests.append((good & (value < low), _said(loc, f"Input should be greater than or equal to {low}")))
        if high is not None:
            tests.append((good & (value > high), _said(loc, f"Input should be less than or equal to {high}")))
        return _errors(*tests)

    return check


def one_of(*values: str) -> Check:
    quoted = [f"'{v}'" for v in values]
    wanted = quoted[0] if len(quoted) == 1 else ", ".join(quoted[:-1]) + " or " + quoted[-1]

    def check(v: Column, loc: Column) -> Column:
        good = (_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").isin(*values)
        return _errors((~good, _said(loc, f"Input should be {wanted}")))

    return check


def array(element: Check, least: int = 0) -> Check:
    def check(v: Column, loc: Column) -> Column:
        is_list = _kind(v).startswith("ARRAY")
        items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>"))
        inner = F.flatten(F.transform(items, lambda x, i: element(x, F.concat(loc, F.lit("."), i.cast("string")))))
        tests = [(~is_list, _said(loc, "Input should be a valid list"))]
        if least:
            few = f"List should have at least {least} item after validation, not 0"
            tests.append((F.size(items) == 0, _said(loc, few)))
        return F.concat(_errors(*tests), F.coalesce(inner, F.array().cast("array<string>")))

    return check


def box(v: Column, loc: Column) -> Column:
    """Four whole numbers in order on the grid."""
    shape = array(number(whole=True))(v, loc)
    b = F.try_variant_get(v, "$", "array<int>")
    out = ~((b[0] >= 0) & (b[0] < b[2]) & (b[2] <= 1000) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= 1000))
    shown = F.concat(F.lit("["), F.array_join(b.cast("array<string>"), ", "), F.lit("]"))
    four = F.size(b) == 4
    wrong = _errors(
        (~four, _said(loc, "Value error, bbox must have exactly 4 integers [x0, y0, x1, y1]")),
        (four & out, F.concat(loc, F.lit(": Value error, bbox "), shown, F.lit(" out of range: need 0<=x0<x1<=1000 and 0<=y0<y1<=1000"))),
    )
    return F.when(F.size(shape) == 0, wrong).otherwise(shape)


@dataclass
class Field:
    check: Check
    required: bool = False
    nullable: bool = False


@dataclass
class Object:
    """Fields by name, in order; others aren't permitted."""

    fields: dict[str, Field] = field(default_factory=dict)

    def __call__(self, v: Column, loc: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        parts = []
        for name, f in self.fields.items():
            at = F.concat(loc, F.lit(f".{name}"))
            value = F.try_variant_get(v, f"$.{name}", "variant")
            there = F.array_contains(keys, name)
            wrong = f.check(value, at)
            if f.nullable:
                wrong = F.when(_kind(value) == "VOID", F.array().cast("array<string>")).otherwise(wrong)
            missing = F.array(_said(at, "Field required")) if f.required else F.array().cast("array<string>")
            parts.append(F.when(there, wrong).otherwise(missing))
        more = F.transform(F.array_sort(F.array_except(keys, F.array(*(F.lit(n) for n in self.fields)))), lambda k: F.concat(loc, F.lit("."), k, F.lit(": Extra inputs are not permitted")))
        is_object = _kind(v).startswith("OBJECT")
        return F.when(is_object, F.concat(*parts, more)).otherwise(F.array(_said(loc, "Input should be an object")))


def optional(check: Check) -> Field:
    return Field(check, nullable=True)


ALIGN = optional(one_of("left", "center", "right", "justify"))
RUN = Object({"text": Field(text, True), "bold": optional(boolean), "italic": optional(boolean), "underline": optional(boolean)})
ITEM = Object({"text": Field(text, True), "runs": Field(array(RUN))})
CELL = Object({"text": Field(text), "colspan": Field(number(1, whole=True)), "rowspan": Field(number(1, whole=True)), "align": ALIGN, "bold": optional(boolean)})


def _strings(*names: str) -> Object:
    return Object({n: optional(text) for n in names})


def _block(tag: str, bbox: Field | None = None, /, **fields: Field) -> Object:
    base = {"confidence": Field(number(0, 1), True), "page": optional(number(1, whole=True)), "bbox": bbox or optional(box), "type": Field(one_of(tag))}
    return Object(base | fields)


TABLE = Field(array(array(CELL)))
#: The block types and their fields.
BLOCKS = {
    "admin_header": _block("admin_header", left=Field(_strings("superior_agency", "issuing_agency", "document_number")), right=Field(_strings("country_name", "motto", "location_and_date"))),
    "heading": _block("heading", level=Field(number(1, 6, whole=True), True), text=Field(text, True), align=ALIGN),
    "paragraph": _block("paragraph", text=optional(text), runs=Field(array(RUN)), align=ALIGN, first_line_indent_pt=optional(number())),
    "list": _block("list", ordered=Field(boolean), marker=Field(text), items=Field(array(ITEM, 1), True)),
    "table": _block("table", headers=TABLE, rows=TABLE),
    "image": _block(
        "image", Field(box, True), kind=Field(one_of("seal", "stamp", "signature", "photo", "diagram"), True), src=optional(text), placement=Field(one_of("floating", "inline")), anchor_block=optional(text)
    ),
    "signature": _block("signature", left=Field(Object({"receipt_list": Field(array(text))})), right=Field(_strings("authority", "title", "name"))),
    "section_break": _block("section_break", orientation=Field(one_of("portrait", "landscape")), page_size=Field(text), label=optional(text)),
    "illegible": _block("illegible", Field(box, True)),
}


def block_errors(v: Column, number_: Column) -> Column:
    """Messages for one block of a chunk."""
    loc = F.concat(F.lit("block blocks."), number_.cast("string"))
    tag = F.try_variant_get(v, "$.type", "string")
    known = ", ".join(f"'{t}'" for t in BLOCKS)
    unknown = F.concat(loc, F.lit(": Input tag '"), tag, F.lit(f"' found using 'type' does not match any of the expected tags: {known}"))
    out = F.when(~_kind(v).startswith("OBJECT") | tag.isNull(), F.array(_said(loc, "Unable to extract tag using discriminator 'type'")))
    for name, check in BLOCKS.items():
        out = out.when(tag == name, check(v, F.concat(loc, F.lit(f".{name}"))))
    return out.otherwise(F.array(unknown))


def checked(chunks: DataFrame) -> DataFrame:
    """chunk_id, n_blocks, errors of chunks (chunk_id, json): an array of blocks, or an object with it as ``blocks``.

    A chunk that is no JSON, or no such array, has no blocks and one error. Blocks are judged
    one a row, so that a chunk of any number of blocks is divided; its first ten errors are kept.
    """
    v = F.try_parse_json("json")
    inner = F.when(_kind(v).startswith("OBJECT"), F.try_variant_get(v, "$.blocks", "variant"))
    body = chunks.select("chunk_id", v.isNull().alias("none"), F.coalesce(inner, v).alias("v"))
    listed = body.withColumn("list", F.when(_kind(F.col("v")).startswith("ARRAY"), F.try_variant_get(F.col("v"), "$", "array<variant>")))
    wrong = F.when(F.col("none"), F.lit("empty response: expected a JSON array of blocks")).when(F.col("list").isNull(), F.lit("expected a JSON array of blocks"))
    heads = listed.select("chunk_id", wrong.alias("wrong"), F.coalesce(F.size("list"), F.lit(0)).alias("n_blocks"))
    blocks = listed.where("list IS NOT NULL").select("chunk_id", F.posexplode("list").alias("i", "b"))
    each = blocks.select("chunk_id", "i", F.slice(block_errors(F.col("b"), F.col("i")), 1, MOST_ERRORS).alias("e")).where("size(e) > 0")
    lines = each.select("chunk_id", "i", F.posexplode("e").alias("k", "message"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("i", "k", "message"))), 1, MOST_ERRORS)
    found = lines.groupBy("chunk_id").agg(F.transform(first, lambda x: x["message"]).alias("found"))
    errors = F.when(F.col("wrong").isNotNull(), F.array("wrong")).otherwise(F.coalesce("found", F.array().cast("array<string>")))
    return heads.join(found, "chunk_id", "left").select("chunk_id", F.greatest(F.col("n_blocks"), F.lit(0)).alias("n_blocks"), errors.alias("errors"))
