"""Queries on placed lines, zones, tables and quotas, with their SQL; registered beside those of ``catalog`` and ``service_catalog``.

The tables have no geometry and no Vietnamese text. Here a page is a chunk of TALL lines, a
line's place is its number on the page, and some lines begin with the words of a header or
signature, by the length and number of the line; the SQL has the same rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import SIGNATURE  # noqa: F401 (the zones' bounds are those of geometry)
from ..operators import assembly, fidelity, operations, zones
from ..sources.tables import table
from .catalog import _COLLAPSED, _FOLDED, _LINES, _lines, _pairs, _sql_bags
from .service_catalog import ORACLES, QUERIES, query  # noqa: F401 (handed on with what is added here)

TALL, SMALL, LARGE = 20, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OPENINGS = {0: ("CỘNG HÒA ", 30), 1: ("Độc lập ", 30), 2: ("Huế, 1 tháng 2 năm 2024 ", 10), 3: ("Số: ", 20), 5: ("TM. ", 30), 6: ("GIÁM ĐỐC ", 30), 7: ("Nơi nhận: ", 30), 8: ("", 20)}


def placed_lines(spark, sf_dir):
    """Lines with page, zone, side and a box; some open like a header's or signature's line."""
    own = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", F.length("text").alias("n"))
    at = F.col("line_no") % TALL
    rule = (F.col("n") + F.col("line_no")) % 11
    said = F.when(rule == 4, F.concat(F.lit("SỞ "), F.translate(F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z ]", ""), SMALL, LARGE)))
    for k, (opening, most) in OPENINGS.items():
        said = said.when(rule == k, F.concat(F.lit(opening), F.substring("text", 1, most)))
    zone = F.when(at < 6, F.lit("header")).when(at >= 12, F.lit("signature")).otherwise(F.lit("body"))
    odd = F.col("n") % 2 == 1
    x0 = F.when(odd, F.lit(550.0)).otherwise(F.lit(60.0))
    return own.select(
        "doc_id", (F.floor(F.col("line_no") / TALL) + 1).alias("page"), "line_no", said.otherwise(F.col("text")).alias("text"), zone.alias("zone"), F.when(odd, F.lit("right")).otherwise(F.lit("left")).alias("side"),
        x0.alias("x0"), (at * 50.0).alias("y"), (x0 + F.least(F.col("n"), F.lit(60)) * 6.0).alias("x1"), (at * 50.0 + 40.0).alias("y1"), "n",
    )


_SAID = " ".join(f"WHEN {k} THEN '{opening}' || substr(text, 1, {most})" for k, (opening, most) in OPENINGS.items())
_PLACED = f"""{_LINES.replace("WITH ", "WITH RECURSIVE ", 1)},
p0 AS (SELECT doc_id, line_no // {TALL} + 1 AS page, line_no, line_no % {TALL} AS k, length(text) AS n,
  CASE (length(text) + line_no) % 11 WHEN 4 THEN 'SỞ ' || translate(regexp_replace(substr(text, 1, 60), '[^A-Za-z ]', '', 'g'), '{SMALL}', '{LARGE}') {_SAID} ELSE text END AS text FROM l),
p AS (SELECT doc_id, page, line_no, text, {_COLLAPSED.format("text")} AS t, n, CASE WHEN k < 6 THEN 'header' WHEN k >= 12 THEN 'signature' ELSE 'body' END AS zone, n % 2 = 1 AS on_right,
  CASE WHEN n % 2 = 1 THEN 550.0 ELSE 60.0 END AS x0, k * 50.0 AS y, CASE WHEN n % 2 = 1 THEN 550.0 ELSE 60.0 END + least(n, 60) * 6.0 AS x1, k * 50.0 + 40.0 AS y1 FROM p0)"""
#: Line by line, as a reader would fill the fields.
_HEADER = f"""{_PLACED}, h AS (SELECT doc_id, line_no, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM p WHERE zone = 'header' AND page = 1 AND t <> ''),
w(doc_id, i, c, m, d, n, rest) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM h
  UNION ALL SELECT doc_id, i, CASE hit WHEN 1 THEN line_no ELSE c END, CASE hit WHEN 2 THEN line_no ELSE m END, CASE hit WHEN 3 THEN line_no ELSE d END, CASE hit WHEN 4 THEN line_no ELSE n END,
    CASE WHEN hit = 5 AND t = upper(t) AND regexp_matches(t, '\\p{{L}}') AND length(t) <= 80 THEN list_append(rest, line_no) ELSE rest END
  FROM (SELECT h.doc_id, h.i, h.line_no, h.t, w.c, w.m, w.d, w.n, w.rest, CASE WHEN c IS NULL AND regexp_matches(t, '(?i)CỘNG\\s+H[OÒ]A') THEN 1 WHEN m IS NULL AND regexp_matches(t, '(?i)Độc\\s+lập') THEN 2
    WHEN d IS NULL AND regexp_matches(t, '\\d{{1,2}}\\s+th[áa]ng\\s+\\d{{1,2}}\\s+năm\\s+\\d{{4}}') THEN 3 WHEN n IS NULL AND regexp_matches(t, '(?i)^S[ốô]\\s*:') THEN 4 ELSE 5 END AS hit
    FROM w JOIN h ON h.doc_id = w.doc_id AND h.i = w.i + 1)),
head AS (SELECT doc_id, c, m, d, n, CASE WHEN len(rest) > 1 THEN rest[1] END AS s, CASE WHEN len(rest) > 1 THEN rest[2] ELSE rest[1] END AS g
  FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE c IS NOT NULL AND m IS NOT NULL OR n IS NOT NULL AND coalesce(c, m, d) IS NOT NULL),
head_used AS (SELECT doc_id, 1::BIGINT AS page, unnest(list_filter([c, m, d, n, s, g], lambda x: x IS NOT NULL)) AS line_no FROM head)"""
_SIGNATURE = """, sl AS (SELECT doc_id, page, line_no, t, on_right, NOT on_right AND regexp_matches(t, '(?i)^Nơi\\s+nhận') AS label FROM p WHERE zone = 'signature' AND t <> ''),
sa AS (SELECT doc_id, page, min(line_no) FILTER (WHERE on_right AND regexp_matches(t, '^(TM\\.|KT\\.)\\s')) AS a, min(line_no) FILTER (WHERE label) AS r FROM sl GROUP BY 1, 2),
sb AS (SELECT doc_id, page, a, r, min(line_no) FILTER (WHERE on_right AND regexp_matches(t, '^GIÁM\\s+ĐỐC') AND line_no IS DISTINCT FROM a) AS b FROM sl JOIN sa USING (doc_id, page) GROUP BY ALL),
sc AS (SELECT doc_id, page, a, r, b, min(line_no) FILTER (WHERE on_right AND line_no IS DISTINCT FROM a AND line_no IS DISTINCT FROM b AND length(t) < 40 AND coalesce(a, b) IS NOT NULL) AS n FROM sl JOIN sb USING (doc_id, page) GROUP BY ALL),
sign AS (SELECT * FROM sc WHERE coalesce(a, b, r) IS NOT NULL),
sign_used AS (SELECT doc_id, page, line_no FROM sl JOIN sign USING (doc_id, page) WHERE line_no IN (a, b, n) OR (r IS NOT NULL AND NOT on_right))"""


def _of(name: str, column: str) -> str:
    return f"(SELECT t FROM p WHERE p.doc_id = head.doc_id AND p.line_no = head.{column}) AS {name}"


@query(
    f"""{_HEADER} SELECT doc_id, {", ".join(_of(*x) for x in (("country_name", "c"), ("motto", "m"), ("location_and_date", "d"), ("document_number", "n"), ("superior_agency", "s"), ("issuing_agency", "g")))},
 (SELECT count(*) FROM head_used u WHERE u.doc_id = head.doc_id) AS n_used FROM head"""
)
def header_blocks(spark, sf_dir):
    """Headers of first pages: each field by the first line that no earlier field took, agencies from what is left."""
    return zones.header_blocks(placed_lines(spark, sf_dir)).withColumn("n_used", F.size("used").cast("long")).drop("used")


@query(
    f"""{_PLACED}{_SIGNATURE}, f AS (SELECT doc_id, page, a, b, r, n, (SELECT string_agg(t, '|' ORDER BY line_no) FROM sl WHERE sl.doc_id = sign.doc_id AND sl.page = sign.page AND NOT on_right AND NOT label AND r IS NOT NULL) AS receipts,
 (SELECT count(*) FROM sign_used u WHERE u.doc_id = sign.doc_id AND u.page = sign.page) AS n_used FROM sign QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) = 1)
SELECT doc_id, page, {", ".join(f"(SELECT t FROM p WHERE p.doc_id = f.doc_id AND p.line_no = f.{c}) AS {name}" for name, c in (("authority", "a"), ("title", "b"), ("receipt_label", "r"), ("name", "n")))}, coalesce(receipts, '') AS receipts, n_used FROM f"""
)
def last_signatures(spark, sf_dir):
    """Signatures with receipt lists, the last one of each document."""
    out = zones.last_signature(zones.signature_cues(placed_lines(spark, sf_dir)))
    return out.withColumn("receipts", F.array_join("receipt_list", "|")).withColumn("n_used", F.size("used").cast("long")).drop("receipt_list", "used")


@query(
    f"""{_HEADER}{_SIGNATURE}, used AS (SELECT * FROM head_used UNION SELECT * FROM sign_used)
SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x0, line_no) AS position FROM p ANTI JOIN used USING (doc_id, page, line_no)"""
)
def zone_lines_restored(spark, sf_dir):
    """Lines of all zones that neither header nor signature used, back in reading order."""
    own = placed_lines(spark, sf_dir)
    every = zones.zone_lines(*(own.where(F.col("zone") == z) for z in ("header", "body", "signature")))
    out = zones.restored(every, zones.used_lines(zones.header_blocks(own)), zones.used_lines(zones.signature_cues(own)))
    return out.select("doc_id", "page", "line_no", F.col("position").cast("long").alias("position"))


def placed_tables(spark, sf_dir):
    """A box for every line whose length divides by nine; such boxes overlap."""
    own = placed_lines(spark, sf_dir).where("n % 9 = 0")
    return own.select("doc_id", "page", (F.col("x0") - 20).alias("x0"), (F.col("y") - 10).alias("y"), (F.col("x0") + 200).alias("x1"), (F.col("y") + 130).alias("y1"))


_TABLES = f"""{_PLACED}, tb AS (SELECT doc_id, page, x0 - 20 AS x0, y - 10 AS y, x0 + 200 AS x1, y + 130 AS y1 FROM p WHERE n % 9 = 0)"""


@query(f"""{_TABLES}, c AS (SELECT doc_id, page, line_no, (SELECT count(*) FROM tb WHERE tb.doc_id = p.doc_id AND tb.page = p.page AND tb.y <= (p.y + p.y1) / 2) AS n FROM p)
SELECT doc_id, page, line_no, max(n) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS slot FROM c""")
def line_slots(spark, sf_dir):
    """For each line, the tables of its page that come before it."""
    return zones.slots(placed_lines(spark, sf_dir), placed_tables(spark, sf_dir)).select("doc_id", "page", "line_no", F.col("slot").cast("long").alias("slot"))


@query(f"""{_TABLES} SELECT doc_id, page, line_no FROM p WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = p.doc_id AND tb.page = p.page
 AND (p.x0 + p.x1) / 2 BETWEEN tb.x0 AND tb.x1 AND (p.y + p.y1) / 2 BETWEEN tb.y AND tb.y1)""")
def lines_outside_tables(spark, sf_dir):
    """Lines that lie in no table of their page."""
    return zones.outside_tables(placed_lines(spark, sf_dir), placed_tables(spark, sf_dir)).select("doc_id", "page", "line_no")


@query(f"{_TABLES} SELECT doc_id, page, CAST(x0 AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x0) AS table_no FROM tb")
def tables_in_order(spark, sf_dir):
    """Tables of a page from the top, then from the left."""
    return zones.in_table_order(placed_tables(spark, sf_dir)).select("doc_id", "page", "x0", "y", F.col("table_no").cast("long").alias("table_no"))


@query(f"""{_PLACED}, c AS (SELECT doc_id, page, CASE WHEN x1 <= 501 THEN 'left' WHEN x0 >= 499 THEN 'right' ELSE 'left' END AS c FROM p)
SELECT doc_id, page, count(*) FILTER (WHERE c = 'left') AS n_left, count(*) FILTER (WHERE c = 'right') AS n_right, count(DISTINCT c) = 2 AS two_columns FROM c GROUP BY 1, 2""")
def page_columns(spark, sf_dir):
    """Lines left and right of the middle of a page that is 1000 wide."""
    out = zones.two_columns(placed_lines(spark, sf_dir).withColumn("width", F.lit(1000.0)))
    n = lambda side: F.sum(F.when(F.col("column") == side, 1).otherwise(0)).alias(f"n_{side}")
    return out.groupBy("doc_id", "page").agg(n("left"), n("right"), F.bool_and("two_columns").alias("two_columns"))


def cut_table_blocks(spark, sf_dir):
    """Lines as blocks, five a page: the last and the first of a page are tables, with one or two columns and with or without headers."""
    own = _lines(spark, sf_dir).select("doc_id", F.col("page").cast("int").alias("page"), F.col("line_no").cast("long").alias("seq"), "text", F.split("text", " ").alias("w"), F.length("text").alias("n"))
    at = F.col("seq") % 5
    cell = lambda t, wide=1: F.struct(t.alias("text"), F.lit(wide).alias("colspan"))
    two = F.col("n") % 2 == 1
    head = F.when(F.col("n") % 3 == 0, F.lit("  MỤC ")).otherwise(F.lit("Mục"))
    none = F.array().cast("array<array<struct<text:string,colspan:int>>>")
    headers = F.when((at == 0) & (F.col("seq") % 3 == 0), none).when(two, F.array(F.array(cell(head, 2)))).otherwise(F.array(F.array(cell(head))))
    row = F.when(two, F.transform(F.slice("w", 1, 2), lambda x: cell(x))).otherwise(F.transform(F.slice("w", 1, 1), lambda x: cell(x)))
    rows = F.when(F.col("n") % 7 == 0, none).otherwise(F.array(row, row))
    box = lambda *v: F.array(*(F.lit(x) for x in v))
    kind = F.when(at.isin(0, 4), F.lit("table")).otherwise(F.lit("paragraph"))
    bbox = F.when(at == 4, box(0, 500, 1000, 900)).when(at == 0, box(0, 100, 1000, 300)).otherwise(box(0, 300, 1000, 500))
    confidence = (F.col("n") % 10) / 10
    return own.select("doc_id", "page", "seq", kind.alias("type"), "text", bbox.alias("bbox"), confidence.alias("confidence"), headers.alias("headers"), rows.alias("rows"))


_WIDTH = "greatest(CASE WHEN hk IS NULL THEN 0 WHEN n % 2 = 1 THEN 2 ELSE 1 END, CASE WHEN n % 7 = 0 THEN 0 ELSE least(len(w), CASE WHEN n % 2 = 1 THEN 2 ELSE 1 END) END)"


@query(
    f"""{_LINES.replace("WITH ", "WITH RECURSIVE ", 1)},
b0 AS (SELECT doc_id, page, line_no AS i, line_no % 5 AS k, length(text) AS n, string_split(text, ' ') AS w, (length(text) % 10) / 10 AS confidence, CASE WHEN line_no % 5 = 0 AND line_no % 3 = 0 THEN NULL ELSE 'mục' END AS hk FROM l),
b AS (SELECT doc_id, page, i, k, confidence, hk, {_WIDTH} AS wide, CASE WHEN n % 7 = 0 THEN [] ELSE [array_to_string(w[1 : CASE WHEN n % 2 = 1 THEN 2 ELSE 1 END], ' ')] END AS r FROM b0),
m(doc_id, i, page, k, wide, hk, has_box, joins) AS (
  SELECT doc_id, i, page, k, wide, hk, true, false FROM b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.i, CASE WHEN j THEN m.page ELSE b.page END, CASE WHEN j THEN m.k ELSE b.k END, CASE WHEN j THEN m.wide ELSE b.wide END, CASE WHEN j THEN m.hk ELSE b.hk END, NOT j, j
  FROM (SELECT m.*, m.has_box AND m.k = 4 AND b.k = 0 AND m.page + 1 = b.page AND m.wide > 0 AND m.wide = b.wide AND m.hk IS NOT NULL AND (b.hk IS NULL OR b.hk = m.hk) AS j FROM m JOIN b ON b.doc_id = m.doc_id AND b.i = m.i + 1) m
  JOIN b ON b.doc_id = m.doc_id AND b.i = m.i + 1),
o AS (SELECT b.doc_id, b.i, b.k, b.confidence, b.r, m.joins, coalesce(lead(m.joins) OVER v, false) AS takes, lead(b.confidence) OVER v AS c2, lead(b.r) OVER v AS r2 FROM b JOIN m USING (doc_id, i) WINDOW v AS (PARTITION BY b.doc_id ORDER BY b.i))
SELECT doc_id, i AS seq, CASE WHEN k IN (0, 4) THEN 'table' ELSE 'paragraph' END AS type, NOT takes AS has_box, round(CASE WHEN takes THEN least(confidence, c2) ELSE confidence END, 6) AS confidence,
 array_to_string(CASE WHEN takes THEN r || r || r2 || r2 ELSE r || r END, '|') AS rows FROM o WHERE NOT joins"""
)
def merged_tables(spark, sf_dir):
    """Blocks after tables that a page break cut were put together, rows and all."""
    blocks = assembly.ordered(assembly.grid_columns(cut_table_blocks(spark, sf_dir)))
    out = assembly.join_cut_tables(assembly.merge_cut_tables(blocks))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), " ")), "|")
    return out.select("doc_id", "seq", "type", F.col("bbox").isNotNull().alias("has_box"), F.round("confidence", 6).alias("confidence"), rows.alias("rows"))


#: Events as a user's charges, and as refunds of the job of their number's remainder on the day that job was first charged.
_QUOTA = """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' OR event_id % 4 = 0 THEN 'refund' ELSE 'charge' END AS op, user_id || ':' || event_id % 5 AS job_id, strftime(CAST(ts AS DATE), '%Y%m') AS month FROM events),
c AS (SELECT user_id, job_id, arg_min(month, struct_pack(t := ts, i := event_id)) AS captured FROM e WHERE op = 'charge' GROUP BY 1, 2),
g AS (SELECT e.*, CASE WHEN op = 'charge' THEN month ELSE captured END AS quota_key FROM e LEFT JOIN c USING (user_id, job_id) WHERE op = 'charge' OR captured IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, quota_key ORDER BY ts, event_id) AS i, op = 'refund' AND row_number() OVER (PARTITION BY user_id, job_id, op ORDER BY ts, event_id) = 1 AS once FROM g),
w(user_id, quota_key, i, event_id, accepted, used) AS (
  SELECT DISTINCT user_id, quota_key, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 0::INTEGER FROM n
  UNION ALL SELECT n.user_id, n.quota_key, n.i, n.event_id, CASE WHEN n.op = 'charge' THEN w.used < 3 ELSE n.once END,
    CASE WHEN n.op = 'charge' THEN CASE WHEN w.used < 3 THEN w.used + 1 ELSE w.used END WHEN n.once THEN greatest(0, w.used - 1) ELSE w.used END
  FROM w JOIN n ON n.user_id = w.user_id AND n.quota_key = w.quota_key AND n.i = w.i + 1)
SELECT user_id, quota_key, event_id, accepted, used FROM w WHERE i > 0"""


@query(_QUOTA)
def refunded_quotas(spark, sf_dir):
    """A monthly quota of three: refunds go to the month that their job was charged in, once, and never below zero."""
    e = table(spark, sf_dir, "events")
    e = e.select("user_id", "ts", "event_id", F.when((F.col("event_type") == "error") | (F.col("event_id") % 4 == 0), F.lit("refund")).otherwise(F.lit("charge")).alias("op"), F.concat_ws(":", "user_id", F.col("event_id") % 5).alias("job_id"), F.date_format("ts", "yyyyMM").alias("month"))
    captured = e.where("op = 'charge'").groupBy("user_id", "job_id").agg(F.min_by("month", F.struct("ts", "event_id")).alias("captured"))
    log = e.join(captured, ["user_id", "job_id"], "left").withColumn("quota_key", F.when(F.col("op") == "charge", F.col("month")).otherwise(F.col("captured"))).where("quota_key IS NOT NULL")
    return operations.refunded_quota(log, 3, ("ts", "event_id")).select("user_id", "quota_key", "event_id", "accepted", "used")


#: Event types as routes, with windows of hours in place of minutes, as a user has few events a day.
ROUTES = {"view": ("upload", 48, 3), "click": ("signup", 24, 1), "purchase": ("forgot-password", 72, 2), "error": ("reset-password", 240, 1)}
_ROUTE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in ROUTES.items()) + " END"
_HOURS = "CASE route " + " ".join(f"WHEN '{r}' THEN {h}" for r, h, _ in ROUTES.values()) + " END"
_MOST = "CASE route " + " ".join(f"WHEN '{r}' THEN {m}" for r, _, m in ROUTES.values()) + " END"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {_ROUTE} AS route FROM events WHERE {_ROUTE} IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY route, user_id ORDER BY ts, event_id) AS i FROM e),
w(route, user_id, i, event_id, since, n) AS (
  SELECT route, user_id, i, event_id, ts, 1 FROM o WHERE i = 1
  UNION ALL SELECT o.route, o.user_id, o.i, o.event_id, CASE WHEN new THEN o.ts ELSE since END, CASE WHEN new THEN 1 ELSE n + 1 END
  FROM (SELECT o.*, w.since, w.n, o.ts >= w.since + to_hours({_HOURS.replace("route", "o.route")}) AS new FROM w JOIN o ON o.route = w.route AND o.user_id = w.user_id AND o.i = w.i + 1) o)
SELECT route, user_id, event_id, n AS in_window, n <= {_MOST} AS allowed FROM w"""
)
def route_limits(spark, sf_dir):
    """Calls of four routes, each with its own windows and limit for a user."""
    route = F.lit(None).cast("string")
    for kind, (name, _, _) in ROUTES.items():
        route = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(route)
    calls = table(spark, sf_dir, "events").withColumn("route", route)
    return operations.route_limited(calls, {r: (h * 3600, m) for r, h, m in ROUTES.values()}).select("route", "user_id", "event_id", "in_window", "allowed")


_FIGURE = "printf('%.4f', round({0}, 4))"


@query(
    _sql_bags("").replace("WITH ", "WITH ", 1)
    + f""", s AS (SELECT pair_id, sum(missing) AS missing, sum(extra) AS extra FROM g GROUP BY pair_id),
c AS (SELECT pair_id, length(e) AS a, length(d) AS b, (coalesce(missing, 0) + coalesce(extra, 0)) / CAST(greatest(length(e), length(d), 1) AS DOUBLE) AS cer FROM q LEFT JOIN s USING (pair_id))
SELECT pair_id, '{{"fidelity":' || {_FIGURE.format("greatest(0.0, 1 - cer)")} || ',"cer":' || {_FIGURE.format("cer")} || ',"extractedChars":' || a || ',"docxChars":' || b || ',"normalization":["casefold","whitespace-collapse","bag-order-free"]}}' AS payload FROM c"""
)
def report_payloads(spark, sf_dir):
    """The report of each pair as JSON with figures of four decimals; its spans are word_divergence_topk's."""
    return fidelity.report_payload(fidelity.ledger_of_bags(_pairs(spark, sf_dir, fidelity.char_bag)))
