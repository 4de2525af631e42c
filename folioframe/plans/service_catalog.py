"""Queries on blocks, vision results, jobs, sessions and catalogs, with their SQL; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import zone
from ..operators import blocktext, changes, operations, registry, schema_diff, structure, styles, triage, vision, zones
from ..sources.tables import table
from .catalog import _LINES, ORACLES, QUERIES, _lines, query  # noqa: F401 (handed on with what is added here)

_BARE = "length(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
KINDS = ("heading", "paragraph", "list", "table", "admin_header", "signature", "section_break", "image")


def typed_blocks(spark, sf_dir):
    """Lines as blocks of all types in turn; a line's words fill the fields of its type."""
    lines = _lines(spark, sf_dir).select("doc_id", "line_no", "text", F.split("text", " ").alias("p"), F.get(F.lit(list(KINDS)), (F.col("line_no") % len(KINDS)).cast("int")).alias("type"))
    word = lambda i: F.get("p", F.lit(i))
    cell = lambda a: F.transform(a, lambda x: F.struct(x.alias("text")))
    rest = F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0)))
    left = F.struct(word(0).alias("superior_agency"), word(1).alias("issuing_agency"), word(2).alias("document_number"), F.slice("p", 1, 3).alias("receipt_list"))
    right = F.struct(*(word(i).alias(n) for i, n in ((3, "country_name"), (4, "motto"), (5, "location_and_date"), (3, "authority"), (4, "title"), (5, "name"))))
    block = F.struct(
        "type", "text", cell(F.split("text", ",")).alias("items"), F.array(cell(F.slice("p", 1, 2))).alias("headers"), F.array(cell(rest)).alias("rows"), left.alias("left"), right.alias("right"), F.col("text").alias("label")
    )
    return lines.select("doc_id", "line_no", block.alias("block"))


_FIELDS = "list_filter([coalesce(x, '') FOR x IN p[1:6]], lambda x: x <> '')"


@query(
    f"""{_LINES}, k AS (SELECT doc_id, line_no, text, string_split(text, ' ') AS p, string_split(text, ',') AS items, line_no % 8 AS k FROM l)
SELECT doc_id, line_no, ['{"', '".join(KINDS)}'][k + 1] AS type,
 CASE k WHEN 2 THEN array_to_string(items, ' ') WHEN 4 THEN array_to_string({_FIELDS}, ' ') WHEN 5 THEN array_to_string({_FIELDS}, ' ') WHEN 7 THEN '' ELSE text END AS block_text,
 CAST(CASE k WHEN 0 THEN {_BARE.format("text")} WHEN 1 THEN {_BARE.format("text")} WHEN 2 THEN list_sum([{_BARE.format("x")} FOR x IN items]) WHEN 3 THEN list_sum([{_BARE.format("x")} FOR x IN p])
  WHEN 4 THEN coalesce(list_sum([{_BARE.format("x")} FOR x IN {_FIELDS}]), 0) WHEN 5 THEN coalesce(list_sum([{_BARE.format("x")} FOR x IN {_FIELDS}]), 0) ELSE 0 END AS BIGINT) AS n_content FROM k"""
)
def block_texts(spark, sf_dir):
    """Text and content size of blocks of every type."""
    b = typed_blocks(spark, sf_dir)
    return b.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("block.type").alias("type"), blocktext.block_text(F.col("block")).alias("block_text"), blocktext.content_chars(F.col("block")).alias("n_content"))


_ASKED = """WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS doc_id FROM pages),
asked AS (SELECT doc_id, page_id AS page, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY page_id) - 1) / 8.0) AS BIGINT) AS batch FROM r),
got AS (SELECT doc_id, batch, page AS seq, CASE WHEN page % 5 = 0 THEN NULL WHEN page % 7 = 0 THEN page + 1000000 ELSE page END AS page, (page % 100) / 100.0 AS confidence FROM asked),
sizes AS (SELECT doc_id, batch, count(*) AS n_asked, min(page) AS only_page FROM asked GROUP BY 1, 2),
paged AS (SELECT doc_id, batch, seq, coalesce(page, CASE WHEN n_asked = 1 THEN only_page END) AS page, confidence FROM got JOIN sizes USING (doc_id, batch)),
judged AS (SELECT p.*, a.page IS NOT NULL AS fits FROM paged p LEFT JOIN asked a ON a.doc_id = p.doc_id AND a.batch = p.batch AND a.page = p.page)"""


def _vision(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("doc_id"))
    asked = operations.pages_in_batches(p, ["doc_id"], ["page"])
    page = F.when(F.col("page") % 5 == 0, F.lit(None)).when(F.col("page") % 7 == 0, F.col("page") + 1_000_000).otherwise(F.col("page"))
    got = asked.select("doc_id", "batch", F.col("page").alias("seq"), page.alias("page"), ((F.col("page") % 100) / 100).alias("confidence"))
    return got, asked


@query(f"{_ASKED} SELECT doc_id, batch, seq, page, CASE WHEN fits THEN round(least(confidence, 0.95), 4) END AS confidence, CASE WHEN NOT fits THEN CASE WHEN page IS NULL THEN 'no page' ELSE 'wrong page' END END AS reason FROM judged")
def vision_blocks(spark, sf_dir):
    """Answers for pages in batches: some without a page, some of a wrong one."""
    kept, dropped = vision.accepted_blocks(*_vision(spark, sf_dir))
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(dropped.withColumn("confidence", F.lit(None).cast("double"))).withColumn("confidence", F.round("confidence", 4))


@query(f"{_ASKED} SELECT a.doc_id, a.batch, a.page FROM asked a WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.fits AND j.doc_id = a.doc_id AND j.batch = a.batch AND j.page = a.page)")
def vision_missing_pages(spark, sf_dir):
    """Pages asked for and not answered."""
    got, asked = _vision(spark, sf_dir)
    return vision.missing_pages(vision.accepted_blocks(got, asked)[0], asked).select("doc_id", "batch", "page")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
l AS (SELECT user_id, list_sort(list(greatest(0.0, value))) AS v, avg(greatest(0.0, least(1.0, value / 100))) AS c FROM r WHERE n <= 500 GROUP BY user_id)
SELECT user_id, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, round(c, 6) AS avg_confidence FROM l"""
)
def recent_samples(spark, sf_dir):
    """Durations and confidences of each user's last 500 events."""
    out = registry.recent_samples(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", F.col("value") / 100)
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    """WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'error' THEN value END AS problem, ts FROM events),
b AS (SELECT *, row_number() OVER w AS n, lag(event_type) OVER w AS before, lag(problem) OVER w AS problem_before FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type FROM b WHERE n = 1 OR before IS DISTINCT FROM event_type OR problem_before IS DISTINCT FROM problem"""
)
def status_changes(spark, sf_dir):
    """Events that tell a user something new."""
    e = table(spark, sf_dir, "events").withColumn("problem", F.when(F.col("event_type") == "error", F.col("value")))
    return registry.changed(e, ["user_id"], ["ts", "event_id"], ["event_type", "problem"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'ok' ELSE 'degraded' END AS status, count(*) AS n_probes FROM events GROUP BY user_id")
def service_readiness(spark, sf_dir):
    """Events as probes of a service per user."""
    return registry.readiness(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "error")


@query(
    """WITH j AS (SELECT user_id, strftime(CAST(ts AS DATE), '%Y%m%d') AS quota_key, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last, bool_or(event_type = 'purchase') AS refunded FROM events GROUP BY 1, 2)
SELECT user_id || ':' || quota_key AS job_id, quota_key, true AS refund_only FROM j WHERE last = 'error' AND NOT refunded"""
)
def refund_queue(spark, sf_dir):
    """A user's day as a job, failed if it ends with an error, refunded if it has a purchase."""
    e = table(spark, sf_dir, "events").withColumn("quota_key", text.day_key(F.col("ts"))).withColumn("job_id", F.concat_ws(":", "user_id", "quota_key"))
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    jobs = e.groupBy("job_id", "quota_key").agg(F.when(last == "error", F.lit("failed")).otherwise(F.lit("completed")).alias("status"))
    refunded = e.where("event_type = 'purchase'").select("job_id").distinct()
    return registry.refund_work(jobs, refunded).select("job_id", "quota_key", "refund_only")


@query("""WITH s AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, value FROM events)
SELECT status, count(*) AS n FROM (SELECT status FROM s UNION ALL SELECT 'failed' FROM s WHERE value < 10) GROUP BY status""")
def outcome_counters(spark, sf_dir):
    """Outcomes with drift counted as a failure on top; an event's value stands for the fidelity, with 10 as its bound."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("completed"))
    return registry.outcomes(e, status, F.col("value"), 10.0)


@query("""WITH n AS (SELECT user_id, event_id, event_type IN ('purchase', 'error') AS done, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, event_type IN ('purchase', 'error') ORDER BY ts, event_id) AS place FROM events)
SELECT user_id, event_id FROM n WHERE NOT (done AND place <= n - 5)""")
def evicted_jobs(spark, sf_dir):
    """A registry of five entries a user: beyond it the oldest finished ones go."""
    return registry.evicted(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("purchase", "error"), 5).select("user_id", "event_id")


@query("SELECT event_type, count(*) AS n_expired FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY event_type")
def expired_artifacts(spark, sf_dir):
    """Events as files, a day old when the last one is written; one of exactly a day goes too."""
    e = table(spark, sf_dir, "events").withColumn("modified", F.col("ts"))
    now = e.agg(F.max("ts")).first()[0]
    return registry.expired(e, 24 * 3600, F.lit(now).cast(e.schema["ts"].dataType)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_expired"))


@query("""SELECT substr(k, 12) AS key, count(*) AS n FROM (SELECT 'quota:' || event_type || ':' || user_id AS k FROM events) WHERE k LIKE 'quota:view:%' GROUP BY 1""")
def prefixed_counters(spark, sf_dir):
    """Counters whose key begins with a prefix."""
    keys = table(spark, sf_dir, "events").select(F.concat_ws(":", F.lit("quota"), "event_type", "user_id").alias("key"), F.lit(1).cast("long").alias("n"))
    return registry.with_prefix(keys, "quota:view:")


@query(
    """WITH a AS (SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'view' THEN {'id': event_id, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM events)
SELECT user_id, t.id AS token, arg_min(event_id, struct_pack(x := ts, i := event_id)) AS claim FROM a WHERE event_type = 'click' AND ts < t.ts + INTERVAL 12 HOUR GROUP BY 1, 2"""
)
def token_claims(spark, sf_dir):
    """A view issues a token for twelve hours, a click claims the last one: only the first claim counts."""
    return registry.claims(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", 12 * 3600)


@query(
    """WITH v AS (SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM events),
a AS (SELECT user_id, max(version) AS version FROM v GROUP BY user_id)
SELECT v.user_id, v.event_id, v.version FROM v JOIN a USING (user_id, version) WHERE user_id % 10 <> 0"""
)
def live_sessions(spark, sf_dir):
    """Each event as a session of its time's version; an error raises the version, users with a round number are disabled."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0))).over(w).cast("long").alias("version"))
    accounts = s.groupBy("user_id").agg(F.max("version").alias("version")).withColumn("disabled", F.col("user_id") % 10 == 0)
    return registry.live_sessions(s, accounts)


@query(
    """WITH f AS (SELECT event_type || (user_id % 50) AS name, event_id AS place, row_number() OVER (PARTITION BY event_type || (user_id % 50) ORDER BY event_id) AS n FROM events),
r AS (SELECT event_type || (user_id % 50) AS name, CASE WHEN event_id % 3 > 0 THEN event_id END AS job_id FROM events)
SELECT r.job_id, r.name, f.place FROM r JOIN f ON f.name = r.name AND f.n = 1 WHERE r.job_id IS NOT NULL"""
)
def bulk_results(spark, sf_dir):
    """Results of a bulk upload with the first file of their name."""
    e = table(spark, sf_dir, "events").withColumn("name", F.concat("event_type", (F.col("user_id") % 50).cast("string")))
    results = e.select("name", F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("job_id"))
    return registry.matched_results(results, e.select("name", F.col("event_id").alias("place"))).select("job_id", "name", "place")


@query(
    """WITH i AS (SELECT o.o_orderkey, c.c_name AS owner, n.n_name AS space, list(l.l_partkey ORDER BY l.l_linenumber, l.l_partkey) AS k FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
 JOIN region r ON r.r_regionkey = n.n_regionkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE r.r_name = 'ASIA' GROUP BY ALL),
u AS (SELECT o_orderkey, owner, space, unnest(k) AS part, generate_subscripts(k, 1) AS place FROM i)
SELECT space, owner, o_orderkey, array_to_string(list(p_name ORDER BY place), ',') AS columns FROM u JOIN part ON p_partkey = part GROUP BY ALL"""
)
def index_columns(spark, sf_dir):
    """Orders as indexes, their lines' parts as key columns in order: joins with an ordered unnest."""
    t = lambda n: table(spark, sf_dir, n)
    keys = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("key"))
    indexes = t("orders").join(keys, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("relation"), "key")
    relations = t("customer").select(F.col("c_custkey").alias("relation"), F.col("c_name").alias("table"), F.col("c_nationkey").alias("space"))
    spaces = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("space"), F.col("n_name").alias("schema"))
    attributes = t("part").select(F.col("p_partkey").alias("attribute"), F.col("p_name").alias("name"))
    found = schema_diff.index_columns(indexes, relations, spaces, attributes)
    return found.select(F.col("schema").alias("space"), F.col("table").alias("owner"), F.col("index").alias("o_orderkey"), F.array_join("columns", ",").alias("columns"))


@query(
    """WITH k AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS own, list(l_suppkey ORDER BY l_linenumber, l_partkey) AS other FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, array_to_string(k.own, ',') AS columns, c.c_name AS referenced, CASE WHEN c.c_custkey IS NULL THEN NULL ELSE array_to_string(k.other, ',') END AS referenced_columns
FROM orders o JOIN k ON k.l_orderkey = o.o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON c.c_custkey = o.o_custkey"""
)
def constraint_columns(spark, sf_dir):
    """Orders as constraints on ordered columns; those of customers in debt refer to another table, the rest to none."""
    t = lambda n: table(spark, sf_dir, n)
    members = t("lineitem").select(F.col("l_orderkey").alias("constraint"), F.struct("l_linenumber", "l_partkey").alias("place"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("referenced_name"))
    heads = t("orders").select(F.col("o_orderkey").alias("constraint"), F.col("o_custkey").alias("target"))
    targets = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("target"), F.col("c_name").alias("referenced"))
    found = schema_diff.constraint_columns(heads, members, targets)
    return found.select(F.col("constraint").alias("o_orderkey"), F.array_join("columns", ",").alias("columns"), "referenced", F.array_join("referenced_columns", ",").alias("referenced_columns"))


@query(
    """WITH a AS (SELECT DISTINCT 'unique' AS kind, c_mktsegment AS name, c_nationkey AS place FROM customer), b AS (SELECT DISTINCT 'foreign' AS kind, n_name AS name, n_regionkey AS place FROM nation)
SELECT kind, name, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS columns FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY kind, name"""
)
def known_keys(spark, sf_dir):
    """Keys of indexes and of constraints together, with their columns in order."""
    indexes = table(spark, sf_dir, "customer").select(F.lit("unique").alias("kind"), F.col("c_mktsegment").alias("table"), F.lit("k").alias("key"), F.col("c_nationkey").alias("place")).distinct()
    foreign = table(spark, sf_dir, "nation").select(F.lit("foreign").alias("kind"), F.col("n_name").alias("table"), F.lit("k").alias("key"), F.col("n_regionkey").alias("place")).distinct()
    keys = schema_diff.key_columns(indexes.unionByName(foreign).withColumn("name", F.col("place").cast("string")))
    return keys.select("kind", F.col("table").alias("name"), F.array_join("columns", ",").alias("columns"))


@query(
    """WITH new AS (SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 3 = 0), kept AS (SELECT * FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT * FROM new),
absent AS (SELECT doc_id, 0 AS quality, 0 AS toxic FROM documents d WHERE doc_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
every AS (SELECT * FROM kept UNION ALL SELECT * FROM absent)
SELECT doc_id, quality, CASE WHEN quality = 0 AND toxic = 0 AND doc_id % 4 = 0 THEN 1 ELSE toxic END AS toxic FROM every WHERE doc_id % 7 <> 0"""
)
def changed_labels(spark, sf_dir):
    """Labels after an upsert, rows created where absent, a delete and an update under a condition."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    now = changes.upsert(labels, labels.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")), ["doc_id"])
    now = changes.create_absent(now, docs.where("doc_id % 10 = 0").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")), ["doc_id"])
    now = changes.delete(now, now.where("doc_id % 7 = 0").select("doc_id"), ["doc_id"])
    return changes.update_where(now, (F.col("quality") == 0) & (F.col("toxic") == 0) & (F.col("doc_id") % 4 == 0), toxic=F.lit(1))


_STYLED = ", ".join(f"('{k}', '{f}', {size}, {str(bold).lower()}, {str(italic).lower()}, {str(upper).lower()}, {'NULL' if align is None else repr(align)})" for k, f, size, bold, italic, upper, align in styles.STYLES)
_FIELD = {"heading": "level_2", "paragraph": "text", "list": "item", "table": "cell", "admin_header": "motto", "signature": "title", "section_break": "label"}
_FIELD_SQL = "CASE k " + " ".join(f"WHEN {KINDS.index(k)} THEN '{f}'" for k, f in _FIELD.items()) + " END"


@query(
    f"""{_LINES}, s(block_type, field, size_pt, bold, italic, upper, align) AS (VALUES {_STYLED}), k AS (SELECT doc_id, line_no, text, line_no % 8 AS k FROM l)
SELECT doc_id, line_no, ['{"', '".join(KINDS)}'][k + 1] AS block_type, CASE WHEN coalesce(upper, false) THEN upper(replace(text, 'ß', 'ss')) ELSE text END AS text, CAST(size_pt AS DOUBLE) AS size_pt, bold, italic, align
FROM k LEFT JOIN s ON s.block_type = ['{"', '".join(KINDS)}'][k + 1] AND s.field = {_FIELD_SQL}"""
)
def render_instructions(spark, sf_dir):
    """Pieces of blocks with their style, looked up by block type and field; pictures have none."""
    b = typed_blocks(spark, sf_dir)
    field = F.lit(None).cast("string")
    for kind, name in _FIELD.items():
        field = F.when(F.col("block.type") == kind, F.lit(name)).otherwise(field)
    pieces = b.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("block.type").alias("block_type"), field.alias("field"), F.col("block.text").alias("text"))
    return styles.instructions(pieces).select("doc_id", "line_no", "block_type", "text", "size_pt", "bold", "italic", "align")


_PLACED = f"""{_LINES}, g AS (SELECT doc_id, page, line_no, (line_no * 37) % 100 AS y, (length(text) * 13) % 600 AS x0 FROM l),
z AS (SELECT *, CASE WHEN y <= 0.25 * 100 THEN 'header' WHEN y >= 0.75 * 100 THEN 'signature' ELSE 'body' END AS zone FROM g),
used AS (SELECT doc_id, page, line_no FROM z WHERE zone = 'header' AND line_no % 3 = 0 UNION SELECT doc_id, page, line_no FROM z WHERE zone = 'signature' AND line_no % 2 = 0)"""


@query(f"{_PLACED} SELECT doc_id, page, line_no, zone, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x0, line_no) AS position FROM z ANTI JOIN used USING (doc_id, page, line_no)")
def restored_lines(spark, sf_dir):
    """Lines in reading order without those that a header or a signature used; a line's number and length give its place."""
    g = _lines(spark, sf_dir).withColumn("y", (F.col("line_no") * 37) % 100).withColumn("x0", (F.length("text") * 13) % 600)
    g = g.withColumn("zone", zone(F.col("y").cast("double"), F.lit(100.0)))
    header, signature = g.where("zone = 'header' AND line_no % 3 = 0"), g.where("zone = 'signature' AND line_no % 2 = 0")
    out = zones.restored(g, header.select("doc_id", "page", "line_no"), signature.select("doc_id", "page", "line_no"))
    return out.select("doc_id", "page", F.col("line_no").cast("long").alias("line_no"), "zone", F.col("position").cast("long").alias("position"))


#: Openings that lines are given in turn, so that every pattern and every turn of the numbering is met.
OPENINGS = ("Điều {n}. ", "Chương II ", "Mục {n} ", "Phần IV ", "{n}. ", "a) ", "b) ", "Căn cứ ", "QUYẾT ĐỊNH: ", "Nơi nhận ", "Phụ lục I ", "ĐIỀU {n}. ", "-c) ", "")


def opened_lines(spark, sf_dir):
    """Lines with openings of all kinds, by a rule on document and line number."""
    turn = ((F.col("doc_id") * 3 + F.floor(F.col("line_no") * 5 / 3)) % len(OPENINGS)).cast("int")
    n = (F.floor(F.col("line_no") / 4) % 3 + 1).cast("string")
    opening = F.replace(F.get(F.lit(list(OPENINGS)), turn), F.lit("{n}"), n)
    return _lines(spark, sf_dir).withColumn("text", F.concat(opening, F.trim("text"))).withColumn("page", F.col("page").cast("int"))


_OPENED = f"""{_LINES}, o AS (SELECT doc_id, page, line_no, n_lines, replace(['{"', '".join(OPENINGS)}'][CAST((doc_id * 3 + floor(line_no * 5 / 3.0)) AS BIGINT) % {len(OPENINGS)} + 1], '{{n}}', CAST(CAST(floor(line_no / 4.0) AS BIGINT) % 3 + 1 AS VARCHAR)) || trim(text) AS text FROM l)"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(trim(text), '{p.replace(chr(92) * 2, chr(92))}') THEN '{k}'" for k, p in structure.PATTERNS.items()) + " ELSE 'paragraph' END"


@query(f"{_OPENED} SELECT doc_id, line_no, {_KIND} AS kind FROM o")
def opened_line_kinds(spark, sf_dir):
    """Kinds of lines, all ten patterns met."""
    return structure.with_pattern(opened_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("kind", F.lit("paragraph")).alias("kind"))


_TURNS = """k AS (SELECT doc_id, line_no, kind, TRY_CAST(CASE kind WHEN 'article' THEN regexp_extract(trim(text), '^(?:ĐIỀU|Điều)\\s+(\\d+)', 1) WHEN 'clause' THEN regexp_extract(trim(text), '^(\\d+)\\.', 1) END AS INTEGER) AS number,
 CASE WHEN kind = 'point' THEN coalesce(nullif(regexp_extract(trim(text), '^([a-z])\\)', 1), ''), 'a') ELSE 'a' END AS letter FROM kinds),
t(doc_id, line_no, state, article, clause, point, final_kind, demoted) AS (
 SELECT DISTINCT doc_id, CAST(-1 AS BIGINT), 'FRONT_MATTER', 0, 0, '', '', false FROM k
 UNION ALL
 SELECT t.doc_id, k.line_no,
  CASE WHEN k.kind = 'preamble_kw' THEN 'PREAMBLE' WHEN k.kind = 'closing_kw' THEN 'CLOSING' WHEN k.kind IN ('chapter', 'article') THEN 'BODY' ELSE t.state END,
  CASE WHEN k.kind = 'chapter' THEN 0 WHEN k.kind = 'article' AND k.number = t.article + 1 THEN k.number ELSE t.article END,
  CASE WHEN k.kind = 'chapter' OR (k.kind = 'article' AND k.number = t.article + 1) THEN 0 WHEN k.kind = 'clause' AND t.state = 'BODY' AND t.article > 0 AND k.number = t.clause + 1 THEN k.number ELSE t.clause END,
  CASE WHEN k.kind = 'chapter' OR (k.kind = 'article' AND k.number = t.article + 1) OR (k.kind = 'clause' AND t.state = 'BODY' AND t.article > 0 AND k.number = t.clause + 1) THEN ''
   WHEN k.kind = 'point' AND t.state = 'BODY' AND t.clause > 0 AND k.letter = CASE WHEN t.point = '' THEN 'a' ELSE chr(ascii(t.point) + 1) END THEN k.letter ELSE t.point END,
  CASE WHEN k.kind = 'article' AND k.number <> t.article + 1 THEN 'paragraph'
   WHEN k.kind = 'clause' AND NOT (t.state = 'BODY' AND t.article > 0) THEN CASE WHEN t.state = 'PREAMBLE' THEN 'list_item' ELSE 'paragraph' END
   WHEN k.kind = 'clause' AND k.number <> t.clause + 1 THEN 'paragraph'
   WHEN k.kind = 'point' AND (t.state <> 'BODY' OR t.clause = 0) THEN 'list_item'
   WHEN k.kind = 'point' AND k.letter <> CASE WHEN t.point = '' THEN 'a' ELSE chr(ascii(t.point) + 1) END THEN 'paragraph' ELSE k.kind END,
  CASE WHEN k.kind = 'article' THEN k.number <> t.article + 1
   WHEN k.kind = 'clause' THEN CASE WHEN t.state = 'BODY' AND t.article > 0 THEN k.number <> t.clause + 1 ELSE t.state <> 'PREAMBLE' END
   WHEN k.kind = 'point' THEN t.state = 'BODY' AND t.clause > 0 AND k.letter <> CASE WHEN t.point = '' THEN 'a' ELSE chr(ascii(t.point) + 1) END ELSE false END
 FROM t JOIN k ON k.doc_id = t.doc_id AND k.line_no = t.line_no + 1)"""


@query(f"{_OPENED} SELECT doc_id, {_KIND} AS kind, count(*) AS n, min(line_no) AS first_line FROM o GROUP BY ALL")
def line_pattern_classes(spark, sf_dir):
    """How often each kind of line stands in a document, and where first."""
    lines = structure.with_pattern(opened_lines(spark, sf_dir))
    return lines.groupBy("doc_id", F.coalesce("kind", F.lit("paragraph")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"))


@query(
    _OPENED.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", kinds AS (SELECT doc_id, line_no, text, {_KIND} AS kind FROM o), {_TURNS}
SELECT t.doc_id, t.final_kind, t.demoted, CAST(CASE WHEN t.demoted THEN 0.6 WHEN k.kind <> 'paragraph' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence, count(*) AS n FROM t JOIN k USING (doc_id, line_no) GROUP BY ALL"""
)
def hierarchy_numbering(spark, sf_dir):
    """Kinds of a document's lines after the numbering check, with the confidence they keep."""
    lines = structure.with_pattern(opened_lines(spark, sf_dir)).withColumn("kind", F.coalesce("kind", F.lit("paragraph")))
    return structure.validated(lines).groupBy("doc_id", "final_kind", "demoted", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    _OPENED.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", kinds AS (SELECT doc_id, line_no, text, {_KIND} AS kind FROM o), {_TURNS}
SELECT t.doc_id, t.line_no, t.final_kind, t.demoted, CAST(CASE WHEN t.demoted THEN 0.6 WHEN k.kind <> 'paragraph' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS confidence FROM t JOIN k USING (doc_id, line_no)"""
)
def opened_numbering(spark, sf_dir):
    """Numbering of articles, clauses and points over such lines: accepted, listed and demoted ones."""
    lines = structure.with_pattern(opened_lines(spark, sf_dir)).withColumn("kind", F.coalesce("kind", F.lit("paragraph")))
    return structure.validated(lines).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "final_kind", "demoted", "confidence")


@query(
    """WITH s AS (SELECT event_id, event_id % 2 AS rejected, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.98 + (event_id % 5) / 200.0 END AS fidelity, event_id % 11 AS n_blocks, event_id % 13 AS out_chars,
 (event_id % 7) / 6.0 AS confidence, (event_id % 17) / 16.0 AS cover, event_id % 4 AS degraded, event_id % 9 + 1 AS n_pages, event_id % 19 = 0 AS first_bad FROM events),
a AS (SELECT *, n_blocks = 0 OR out_chars = 0 AS nothing, CASE WHEN n_blocks = 0 OR out_chars = 0 THEN 0.0 ELSE round_even(least(confidence, cover), 3) END AS score FROM s),
b AS (SELECT *, CASE WHEN degraded > 0 THEN CASE WHEN degraded / n_pages > 0.3 OR first_bad THEN 'failed' ELSE 'completed_with_warnings' END WHEN nothing THEN 'failed' WHEN cover < 0.6 OR rejected > 0 OR coalesce(fidelity, 1) < 0.99 THEN 'completed_with_warnings' ELSE 'completed' END AS first_status FROM a)
SELECT event_id, CASE WHEN first_status <> 'failed' AND score < 0.8 THEN 'completed_with_warnings' ELSE first_status END AS status, CAST(score AS DOUBLE) AS confidence FROM b"""
)
def status_cascade(spark, sf_dir):
    """Statuses of conversions whose figures come from event numbers, so that every rule is reached."""
    i = F.col("event_id")
    fidelity = F.when(i % 3 == 0, F.lit(None).cast("double")).otherwise(0.98 + (i % 5) / 200)
    status = triage.conversion_status(i % 2, fidelity, i % 11, i % 13, (i % 7) / 6, (i % 17) / 16, i % 4, i % 9 + 1, i % 19 == 0)
    return table(spark, sf_dir, "events").select("event_id", status["status"].alias("status"), status["confidence"].alias("confidence"))


@query(
    """WITH p AS (SELECT page_id, html, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'Trang ngắn' ELSE repeat('Điều khoản về việc bảo vệ môi trường và sức khỏe của người dân. ', 3) END AS t, (page_id % 4) / 4.0 AS share, page_id % 3 AS n_tables FROM pages)
SELECT page_id, CASE WHEN t = '' OR (share >= 0.7 AND length(trim(t)) < 150) THEN 'SCANNED' WHEN page_id % 5 = 1 THEN 'SCANNED' WHEN n_tables > 0 THEN 'TABLE_HEAVY' ELSE 'DIGITAL_TEXT' END AS page_class FROM p"""
)
def page_classes(spark, sf_dir):
    """Pages with and without text, pictures and tables, so that the branches for these are reached."""
    i = F.col("page_id")
    long_ = F.lit("Điều khoản về việc bảo vệ môi trường và sức khỏe của người dân. ")
    t = F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, F.lit("Trang ngắn")).otherwise(F.repeat(long_, F.lit(3)))
    p = table(spark, sf_dir, "pages").select("page_id", t.alias("t"), F.array(F.struct(((i % 4) * 25.0).alias("w"), F.lit(100.0).alias("h"))).alias("images"), (i % 3).alias("n_tables"))
    share = triage.image_share(F.col("images"), F.lit(100.0), F.lit(100.0))
    return p.select("page_id", triage.page_class(F.col("t"), share, F.col("n_tables")).alias("page_class"))
