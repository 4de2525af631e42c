"""Queries on single rules: texts of lines, boxes of placed things, grids and cells, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry, service, text
from ..operators import assembly, fidelity, inline, registry, structure, triage, validation, zones
from ..sources import blocks
from ..sources.tables import table
from . import service_catalog
from .catalog import _COLLAPSED, _LINES, PAGE_LINES, _lines
from .page_catalog import ORACLES, QUERIES, query  # noqa: F401 (handed on with what is added here)
from .runtime import shared_dir

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"""{_LINES} SELECT doc_id, line_no, {_COLLAPSED.format("translate(text, chr(160) || chr(173), ' -')")} AS clean, text = upper(text) AND regexp_matches(text, '\\p{{L}}') AS upper_case,
 text = upper(text) AND regexp_matches(text, '\\p{{L}}') AND length(text) <= 80 AS agency, substr({_COLLAPSED.format("text")}, 1, 80) AS preview,
 CASE WHEN regexp_matches(text, '^[a-y]') THEN chr(ascii(text) + 1) WHEN text = '' THEN 'a' END AS next_letter,
 regexp_replace(replace(regexp_replace(regexp_replace(text, '[/\\\\]', '_', 'g'), '[^\\p{{L}}\\p{{N}}\\-_.() ]', '', 'g'), ' ', '_'), '^[._]+|[._]+$', '', 'g') AS file_name, sha256(text) AS token_hash,
 array_to_string([CASE WHEN line_no % 2 = 0 THEN chr(CAST(99 + i AS INTEGER)) || ')' ELSE (i + 1) || '.' END FOR i IN range(0, length(text) % 5)], ' ') AS markers FROM l"""
)
def line_texts(spark, sf_dir):
    """Cleaning, letter case, agencies, previews, next letters, file names, hashes and list markers of lines."""
    own = _lines(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("long"))
    t = F.col("text")
    letter = F.when(t.rlike("^[a-y]"), text.next_letter(F.substring(t, 1, 1))).when(t == "", text.next_letter(t))
    marker = F.when(F.col("line_no") % 2 == 0, F.lit("c)")).otherwise(F.lit("1."))
    return own.select(
        "doc_id", "line_no", text.clean_line(t).alias("clean"), text.is_upper(t).alias("upper_case"), text.is_agency(t).alias("agency"), text.preview(t).alias("preview"), letter.alias("next_letter"),
        text.safe_filename(t).alias("file_name"), service.token_hash(t).alias("token_hash"), F.array_join(assembly.list_markers(F.length(t) % 5, marker), " ").alias("markers"),
    )


#: Line items as things placed on a page of 612 x 792: quantity, line number and keys give the corners.
_X0, _Y0 = "l_quantity * 12 + l_linenumber", "l_partkey % 801 - 4.0"
_X1, _Y1 = f"{_X0} + l_suppkey % 90 - 2.0", f"{_Y0} + l_orderkey % 50"


def _low(v: str, size: int) -> str:
    return f"greatest(0, least(999, CAST(round_even(1000 * ({v}) / {size}.0, 0) AS INTEGER)))"


def _high(v: str, size: int, least: str) -> str:
    return f"greatest({least}, least(1000, CAST(round_even(1000 * ({v}) / {size}.0, 0) AS INTEGER)))"


_BOXES = f"""WITH s AS (SELECT l_orderkey, l_linenumber, {_X0} AS x0, {_Y0} AS y0, {_X1} AS x1, {_Y1} AS y1, l_returnflag AS flag FROM lineitem),
b AS (SELECT *, {_low("x0", 612)} AS a0, {_low("y0", 792)} AS b0 FROM s),
c AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN [a0, b0, {_high("x1", 612, "a0 + 1")}, {_high("y1", 792, "b0 + 1")}] END AS line_box, [a0, b0, {_high("x1", 612, "1")}, {_high("y1", 792, "1")}] AS tb FROM b),
d AS (SELECT *, CASE WHEN tb[3] > tb[1] AND tb[4] > tb[2] THEN tb END AS table_box FROM c)"""


def _placed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.select("l_orderkey", "l_linenumber", *(F.expr(e).alias(n) for n, e in (("x0", _X0), ("y0", _Y0), ("x1", _X1), ("y1", _Y1))), F.col("l_returnflag").alias("flag"))
    at = [F.col(c) for c in ("x0", "y0", "x1", "y1")] + [F.lit(612.0), F.lit(792.0)]
    return s.withColumn("own", geometry.line_box(*at)).withColumn("grid", geometry.table_box(*at))


@query(
    f"""{_BOXES} SELECT l_orderkey, l_linenumber, array_to_string(line_box, ' ') AS line_box, array_to_string(table_box, ' ') AS table_box,
 abs((x0 + x1) / 2 - 306) < 0.08 * 612.0 AND x1 - x0 < 0.60 * 612.0 AS centred, x0 > 0.12 * 612.0 AS indented, CASE WHEN x0 < 0.40 * 612.0 THEN 'left' ELSE 'right' END AS side,
 CASE WHEN flag IN ('A', 'N') AND (line_box[2] + line_box[4]) / 2 >= 750 THEN 'signature' END AS anchored, CAST(trunc(line_box[1] / 1000 * 7772400) AS BIGINT) AS emu,
 CAST(greatest(1, len(list_filter([0, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000], lambda q: q >= line_box[1] - 0.5 AND q < line_box[3] - 0.5))) AS BIGINT) AS span FROM d"""
)
def placed_boxes(spark, sf_dir):
    """Line and table boxes on the grid, and what follows from them: place, side, anchor, length units and spans."""
    p = _placed(spark, sf_dir)
    box, width = F.col("own"), F.lit(612.0)
    kind = F.when(F.col("flag") == "A", F.lit("seal")).when(F.col("flag") == "N", F.lit("stamp")).otherwise(F.lit("photo"))
    bounds = F.array(*(F.lit(v) for v in range(0, 1001, 100)))
    span = F.when(box.isNotNull(), geometry.span(box[0], box[2], bounds)).otherwise(F.lit(1))
    return p.select(
        "l_orderkey", "l_linenumber", F.array_join(box.cast("array<string>"), " ").alias("line_box"), F.array_join(F.col("grid").cast("array<string>"), " ").alias("table_box"), geometry.is_centered(F.col("x0"), F.col("x1"), width).alias("centred"),
        geometry.is_indented(F.col("x0"), width).alias("indented"), geometry.side(F.col("x0"), width).alias("side"), geometry.anchor(kind, box).alias("anchored"), geometry.emu(box[0], F.lit(7_772_400)).alias("emu"), span.cast("long").alias("span"),
    )


@query(f"{_BOXES} SELECT l_orderkey, count(line_box) AS n, CASE WHEN count(line_box) > 0 THEN concat_ws(' ', min(line_box[1]), min(line_box[2]), max(line_box[3]), max(line_box[4])) END AS box FROM d GROUP BY l_orderkey")
def united_boxes(spark, sf_dir):
    """The box around all lines of an order."""
    box = geometry.union_box(F.col("own"))
    return _placed(spark, sf_dir).groupBy("l_orderkey").agg(F.count("own").alias("n"), F.array_join(box.cast("array<string>"), " ").alias("box"))


_KIND = "CASE WHEN {c} AND {b} AND u AND n < 60 AND o THEN 'title' WHEN size > base AND {b} THEN 'heading' ELSE 'paragraph' END"


@query(
    f"""{_LINES}, s AS (SELECT doc_id, line_no, text, length(text) AS n, CAST(10 + length(text) % 7 AS DOUBLE) AS size, length(text) % 3 = 0 AS bold, line_no % 2 = 0 AS centred, text = upper(text) AND regexp_matches(text, '\\p{{L}}') AS u, NOT regexp_matches(text, '[.:;,!?]$') AS o FROM l),
m AS (SELECT doc_id, coalesce(median(size) FILTER (WHERE length(trim(text)) >= 20), median(size), 14.0) AS base FROM s GROUP BY doc_id),
k AS (SELECT s.*, base, {_KIND.format(c="centred", b="bold")} AS kind FROM s JOIN m USING (doc_id))
SELECT doc_id, line_no, base, kind, CASE WHEN kind = 'paragraph' THEN 'paragraph' ELSE 'heading' END AS type, CASE kind WHEN 'title' THEN 1 WHEN 'heading' THEN 2 END AS level, CASE kind WHEN 'title' THEN 'center' WHEN 'heading' THEN 'left' ELSE 'justify' END AS align,
 CASE WHEN kind = 'paragraph' THEN 36.0::DOUBLE END AS indent FROM k"""
)
def typography_blocks(spark, sf_dir):
    """Lines with sizes from their lengths: the usual size of a document, kinds by typography, the blocks these become and their indents."""
    t = F.col("text")
    own = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", (F.lit(10.0) + F.length(t) % 7).alias("size"), (F.length(t) % 3 == 0).alias("bold"), (F.col("line_no") % 2 == 0).alias("centered"))
    base = own.groupBy("doc_id").agg(structure.baseline(F.col("size"), t).alias("base"))
    kinds = own.join(base, "doc_id").withColumn("kind", structure.typography_kind(t, F.col("centered"), F.col("bold"), F.col("size"), F.col("base")))
    out = kinds.withColumn("b", structure.block_of(F.col("kind")))
    return out.select("doc_id", "line_no", "base", "kind", "b.type", "b.level", "b.align", inline.first_line_indent(F.col("b.type"), F.col("b.align")).alias("indent"))


_BARE = _STRIP.format("text")
_UNIT = "(" + service_catalog._KIND.replace("trim(text)", _BARE) + " <> 'paragraph' OR (centred AND length(text) < 60 AND (bold OR (text = upper(text) AND regexp_matches(text, '\\p{L}')))))"
_WRAPPED = f"""{_LINES.replace("WITH ", "WITH RECURSIVE ", 1)}, a AS (SELECT doc_id, page, line_no, text, {_BARE} AS bare, line_no % {PAGE_LINES} * 12.0 AS y, line_no % {PAGE_LINES} * 12.0 + CASE WHEN length(text) % 4 = 0 THEN 4 ELSE 10 END AS y1,
 length(text) * 5.0 AS x1, CAST(10 + length(text) % 7 * 0.5 AS DOUBLE) AS size, length(text) % 3 = 0 AS bold, line_no % 5 = 0 AS centred FROM l),
u AS (SELECT *, {_UNIT.replace("length(text)", "length(bare)").replace("text = upper(text)", "bare = upper(bare)").replace("regexp_matches(text", "regexp_matches(bare")} AS unit FROM a),
f AS (SELECT *, row_number() OVER w AS i, coalesce(lag(bare) OVER w <> '' AND NOT regexp_matches(lag(bare) OVER w, '[.:;!?"]$') AND y - lag(y1) OVER w < 1.6 * greatest(lag(y1) OVER w - lag(y) OVER w, 1.0)
 AND lag(page) OVER w = page AND lag(centred) OVER w = centred AND NOT unit, false) AS follows FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no)),
t(doc_id, i, part, most) AS (SELECT doc_id, i, CAST(1 AS BIGINT), size FROM f WHERE i = 1
 UNION ALL SELECT doc_id, i, part + CASE WHEN stays THEN 0 ELSE 1 END, CASE WHEN stays THEN greatest(most, size) ELSE size END FROM (SELECT t.doc_id, f.i, part, most, size, follows AND abs(size - most) <= 1.5 AS stays FROM t JOIN f ON f.doc_id = t.doc_id AND f.i = t.i + 1)),
m AS (SELECT doc_id, min(line_no) AS line_no, count(*) AS n_lines, arg_min(text, i) AS first, string_agg(bare, ' ' ORDER BY i) AS bares, arg_min(bare, i) AS first_bare, arg_min(centred, i) AS centred, bool_or(bold) AS bold, max(size) AS size FROM t JOIN f USING (doc_id, i) GROUP BY doc_id, part),
v AS (SELECT *, CASE WHEN n_lines = 1 THEN first ELSE regexp_replace(first, '\\s+$', '') || ' ' || substr(bares, length(first_bare) + 2) END AS text FROM m),
z AS (SELECT doc_id, coalesce(median(size) FILTER (WHERE length(trim(text)) >= 20), median(size), 14.0) AS base FROM a GROUP BY doc_id),
k AS (SELECT v.*, base, CASE WHEN centred AND bold AND text = upper(text) AND regexp_matches(text, '\\p{{L}}') AND length(text) < 60 AND NOT regexp_matches(text, '[.:;,!?]$') THEN 'title' WHEN size > base AND bold THEN 'heading' ELSE 'paragraph' END AS kind FROM v JOIN z USING (doc_id))"""


@query(
    f"""{_WRAPPED} SELECT doc_id, line_no, n_lines, length(text) AS n_chars, size, base, kind, CASE WHEN kind = 'paragraph' THEN 'paragraph' ELSE 'heading' END AS type,
 CASE kind WHEN 'title' THEN 'center' WHEN 'heading' THEN 'left' ELSE 'justify' END AS align, CASE WHEN kind = 'paragraph' THEN 36.0::DOUBLE END AS indent FROM k"""
)
def wrapped_blocks(spark, sf_dir):
    """From lines to blocks: the usual size of a document, wrapped lines joined, kinds by typography, blocks and indents; sizes and places come from lengths and line numbers."""
    n, t = F.length("text"), F.col("text")
    y = F.col("line_no") % PAGE_LINES * 12.0
    own = _lines(spark, sf_dir).select(
        "doc_id", "page", F.col("line_no").cast("long").alias("line_no"), "text", y.alias("y"), (y + F.when(n % 4 == 0, F.lit(4)).otherwise(F.lit(10))).alias("y1"), F.lit(0.0).alias("x0"), (n * 5.0).alias("x1"),
        (F.lit(10.0) + n % 7 * 0.5).alias("size"), (n % 3 == 0).alias("bold"), (F.col("line_no") % 5 == 0).alias("centered"),
    )
    base = own.groupBy("doc_id").agg(structure.baseline(F.col("size"), t).alias("base"))
    kinds = structure.merge_wrapped(own).join(base, "doc_id").withColumn("kind", structure.typography_kind(t, F.col("centered"), F.col("bold"), F.col("size"), F.col("base")))
    out = kinds.withColumn("b", structure.block_of(F.col("kind")))
    return out.select("doc_id", "line_no", F.col("n_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_chars"), "size", "base", "kind", "b.type", "b.align", inline.first_line_indent(F.col("b.type"), F.col("b.align")).alias("indent"))


#: Orders as tables of three rows: an item's quantity gives the spans of its cell.
_GRID = """WITH RECURSIVE i AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS i, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
c AS (SELECT table_id, i, (i - 1) // 3 AS row_no, 1 + q % 3 AS wide, 1 + q // 3 % 3 AS high, CAST(q AS VARCHAR) AS text FROM i),
z AS (SELECT table_id, max(w) AS n, max(row_no) + 1 AS m FROM (SELECT table_id, row_no, sum(wide) AS w FROM c GROUP BY 1, 2) GROUP BY 1),
w(table_id, i, row_no, busy, nxt, r, col, r_end, col_end, text) AS (
  SELECT table_id, 0::BIGINT, 0::BIGINT, list_transform(range(CAST(n AS BIGINT)), lambda x: 0::BIGINT), 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM z
  UNION ALL SELECT table_id, i, row_no, CASE WHEN p IS NULL THEN busy ELSE list_transform(busy, lambda h, k: CASE WHEN k - 1 BETWEEN p AND least(p + wide, n) - 1 THEN greatest(h, least(row_no + high, m)) ELSE h END) END,
    CASE WHEN p IS NULL THEN n ELSE p + wide END, row_no, p, least(row_no + high, m) - 1, least(p + wide, n) - 1, text
  FROM (SELECT c.table_id, c.i, c.row_no, c.wide, c.high, c.text, w.busy, CAST(z.n AS BIGINT) AS n, z.m, list_filter(range(CAST(z.n AS BIGINT)), lambda k: k >= CASE WHEN c.row_no > w.row_no THEN 0 ELSE w.nxt END AND w.busy[k + 1] <= c.row_no)[1] AS p
    FROM w JOIN c ON c.table_id = w.table_id AND c.i = w.i + 1 JOIN z ON z.table_id = w.table_id))
SELECT table_id, r, col AS c, r_end, col_end AS c_end, text FROM w WHERE col IS NOT NULL"""


@query(_GRID)
def table_grids(spark, sf_dir):
    """Cells of tables with spans over rows and columns, laid on their grid."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(order)).alias("items"))  # an order's few items
    q = lambda x: x["l_quantity"].cast("int")
    cell = lambda x: F.struct(q(x).cast("string").alias("text"), (1 + q(x) % 3).alias("colspan"), (1 + (q(x) / 3).cast("int") % 3).alias("rowspan"))
    rows = F.transform(F.sequence(F.lit(0), ((F.size("items") - 1) / 3).cast("int")), lambda k: F.transform(F.slice("items", k * 3 + 1, F.lit(3)), cell))
    out = inline.grid_places(items.select("table_id", rows.alias("rows")))
    return out.select("table_id", *(F.col(c).cast("long").alias(c) for c in ("r", "c", "r_end", "c_end")), "text")


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber // 3 AS r, l_linenumber % 3 AS c, CASE WHEN l_quantity < 15 THEN '  ' ELSE l_returnflag END AS text FROM lineitem)
SELECT table_id, round(count(*) FILTER (WHERE trim(text) <> '') / CAST(count(*) AS DOUBLE), 6) AS fill, CAST(max(c) - min(c) + 1 AS INTEGER) AS n_columns FROM c GROUP BY table_id
HAVING count(*) FILTER (WHERE trim(text) <> '') / CAST(count(*) AS DOUBLE) >= {fill} AND max(c) - min(c) + 1 >= {columns}""".format(fill=triage.FILL, columns=triage.COLUMNS))
def accepted_tables(spark, sf_dir):
    """Orders as tables of three columns, cells of small quantities blank: which have enough columns and filled cells."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("table_id"), F.floor(F.col("l_linenumber") / 3).alias("row"), (F.col("l_linenumber") % 3).alias("col"), F.when(F.col("l_quantity") < 15, F.lit("  ")).otherwise(F.col("l_returnflag")).alias("text"))
    return triage.accepted_tables(cells).withColumn("fill", F.round("fill", 6))


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS r, CAST(l_quantity AS INTEGER) AS c, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 || ' ' || l_suppkey % 2 END AS box FROM lineitem)
SELECT table_id, r AS "row", c AS col, box FROM c QUALIFY box IS NULL OR row_number() OVER (PARTITION BY table_id, box ORDER BY r, c) = 1""")
def distinct_cells(spark, sf_dir):
    """Cells that share a box with an earlier one of their table go; cells without a box stay."""
    li = table(spark, sf_dir, "lineitem")
    box = F.when(F.col("l_partkey") % 4 > 0, F.concat_ws(" ", F.col("l_partkey") % 4, F.col("l_suppkey") % 2))
    return zones.distinct_cells(li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("col"), box.alias("bbox"))).withColumnRenamed("bbox", "box")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 = 0 AS pred, l_returnflag = 'A' AND l_linestatus IS NOT NULL AS seal FROM lineitem),
n AS (SELECT doc_id, count(*) FILTER (WHERE seal AND pred) AS pred, count(*) FILTER (WHERE seal AND NOT pred) AS gold FROM s GROUP BY doc_id)
SELECT doc_id, pred, gold, round(CASE WHEN gold = 0 THEN 1.0 ELSE least(pred, gold) / CAST(gold AS DOUBLE) END, 6) AS recall FROM n""")
def seal_recalls(spark, sf_dir):
    """Items of an order as pictures of two sides: how many of one side's seals the other has."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("pred")).otherwise(F.lit("gold")).alias("side"), F.lit("image").alias("type"), F.when(F.col("l_returnflag") == "A", F.lit("seal")).otherwise(F.lit("photo")).alias("kind"))
    return fidelity.seal_recall(rows).withColumn("recall", F.round("recall", 6))


_TAGS = ", ".join(f"'{t}'" for t in validation.BLOCKS).replace("'", "''")
_AT = "'block blocks.' || i || '.'"


@query(
    f"""{_LINES}, b AS (SELECT doc_id, page, line_no % 5 AS i, length(text) AS n FROM l),
e AS (SELECT doc_id, page, i, CASE n % 6 WHEN 1 THEN [{_AT} || 'heading.confidence: Input should be less than or equal to 1', {_AT} || 'heading.level: Field required']
 WHEN 2 THEN [{_AT} || 'paragraph.colour: Extra inputs are not permitted'] WHEN 3 THEN [{_AT} || 'table.rows.0.0.colspan: Input should be greater than or equal to 1']
 WHEN 4 THEN ['block blocks.' || i || ': Input tag ''poem'' found using ''type'' does not match any of the expected tags: {_TAGS}']
 WHEN 5 THEN CASE WHEN n > 1000 THEN [{_AT} || 'illegible.bbox: Value error, bbox [0, 0, 1000, ' || n || '] out of range: need 0<=x0<x1<=1000 and 0<=y0<y1<=1000'] ELSE [] END ELSE [] END AS m FROM b)
SELECT doc_id || ':' || page AS chunk_id, CASE WHEN doc_id % 20 = 7 THEN 0 ELSE count(*) END AS n_blocks,
 CASE WHEN doc_id % 20 = 7 THEN 'empty response: expected a JSON array of blocks' ELSE array_to_string(flatten(list(m ORDER BY i))[1:10], ' | ') END AS errors FROM e GROUP BY doc_id, page"""
)
def chunk_checks(spark, sf_dir):
    """Chunks of five lines as blocks in JSON, most of them with a fault and some cut off, and their errors."""
    own = _lines(spark, sf_dir).select("doc_id", "page", (F.col("line_no") % 5).alias("i"), "text", F.length("text").alias("n"))
    said = lambda **cells: F.to_json(F.struct(*(c.alias(n) for n, c in cells.items())))
    half, t = F.lit(0.5), F.col("text")
    kinds = [
        said(type=F.lit("heading"), confidence=half, level=F.lit(2), text=t),
        said(type=F.lit("heading"), confidence=F.lit(1.5), text=t),
        said(type=F.lit("paragraph"), confidence=half, text=t, colour=F.lit("x")),
        said(type=F.lit("table"), confidence=half, rows=F.array(F.array(F.struct(t.alias("text"), F.lit(0).alias("colspan"))))),
        said(type=F.lit("poem"), text=t),
        said(type=F.lit("illegible"), confidence=half, bbox=F.array(F.lit(0), F.lit(0), F.lit(1000), F.col("n"))),
    ]
    block = kinds[0]
    for k, other in enumerate(kinds[1:], 1):
        block = F.when(F.col("n") % 6 == k, other).otherwise(block)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"])
    body = own.groupBy("doc_id", "page").agg(listed.alias("b"))
    json = F.concat(F.lit("["), F.array_join("b", ","), F.when(F.col("doc_id") % 20 == 7, F.lit("")).otherwise(F.lit("]")))
    out = validation.checked(body.select(F.concat_ws(":", "doc_id", "page").alias("chunk_id"), json.alias("json")))
    return out.select("chunk_id", F.col("n_blocks").cast("long").alias("n_blocks"), F.array_join("errors", " | ").alias("errors"))


@query(
    f"""{_LINES} SELECT doc_id, count(*) FILTER (WHERE length(text) % 10 <> 3) AS n_blocks, CAST(coalesce(sum(length(text)) FILTER (WHERE length(text) % 10 <> 3), 0) AS BIGINT) AS chars,
 count(*) FILTER (WHERE length(text) % 10 <> 3 AND line_no % 4 = 0) AS n_headings, count(*) FILTER (WHERE length(text) % 10 = 3) AS n_broken FROM l GROUP BY doc_id"""
)
def blocks_round_trip(spark, sf_dir):
    """All lines written as blocks in JSON and read back; records that are cut off are kept apart."""
    own = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("int").alias("seq"), "text", F.length("text").alias("n"))
    level = F.when(F.col("seq") % 4 == 0, F.lit(2))
    block = own.select("doc_id", "seq", F.when(level.isNotNull(), F.lit("heading")).otherwise(F.lit("paragraph")).alias("type"), F.lit(0.5).alias("confidence"), "text", level.alias("level"), "n")
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    blocks.write_blocks(block.where("n % 10 <> 3").drop("n"), f"{path}/part=whole")
    cut = F.concat(F.lit('{"doc_id":'), F.col("doc_id"), F.lit(',"text":"cut off'))
    block.where("n % 10 = 3").select(cut.alias("value")).write.text(f"{path}/part=cut")
    good, broken = blocks.read_records(spark, path, f"doc_id long, seq int, {blocks.BLOCK}")
    rows = good.select("doc_id", "text", "level", F.lit(0).alias("broken")).unionByName(
        broken.select(F.regexp_extract(blocks.BROKEN, r'^\{"doc_id":(-?\d+)', 1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(1).alias("broken"))
    )
    n = lambda test: F.count_if(test)
    whole = F.col("broken") == 0
    return rows.groupBy("doc_id").agg(n(whole).alias("n_blocks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), n(whole & F.col("level").isNotNull()).alias("n_headings"), n(~whole).alias("n_broken"))


@query("""WITH asked AS (SELECT event_id, 'token-' || event_id % 4000 AS token FROM events), tokens AS (SELECT sha256('token-' || event_id) AS token_hash, user_id FROM events WHERE event_id % 3 = 0)
SELECT event_id, token, user_id, c_name AS name FROM (SELECT event_id, token, sha256(token) AS token_hash FROM asked) JOIN tokens USING (token_hash) JOIN customer ON c_custkey = user_id""")
def token_users(spark, sf_dir):
    """Events as visits with a token, every third one's as issued: who visits."""
    e = table(spark, sf_dir, "events")
    asked = e.select("event_id", F.concat(F.lit("token-"), F.col("event_id") % 4000).alias("token"))
    tokens = e.where("event_id % 3 = 0").select(service.token_hash(F.concat(F.lit("token-"), F.col("event_id"))).alias("token_hash"), "user_id")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return registry.token_users(asked, tokens, users).select("event_id", "token", "user_id", "name")
