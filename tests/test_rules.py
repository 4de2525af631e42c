"""Literal cases of the rules, and folds against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions import geometry, legacy, text
from folioframe.operators import assembly, fidelity, inline, operations, schema_diff, structure, triage, zones
from folioframe.sources import blocks
from folioframe.streaming import jobs


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "raw,plain,code",
    [("Céng hßa x· héi chñ nghÜa ViÖt Nam", "Cộng hòa xã hội chủ nghĩa Việt Nam", "TCVN3"), ("Vieät Nam ñaõ ñoäc laäp", "Việt Nam đã độc lập", "VNI")],
)
def test_decoding(spark, raw, plain, code):
    found = values(spark, legacy.best_decoding(F.col("t")), [(raw,), (plain,), ("plain words",), ("",)], "t string")
    assert (found[0].encoding, found[0].text) == (code, plain)
    assert [f.encoding for f in found[1:]] == [None, None, None]


@pytest.mark.parametrize("code", [legacy.TCVN3, legacy.VNI])
def test_decoding_round_trip_against_plain_version(spark, code):
    r = random.Random(1)
    keys = [*code.single, *code.pairs, *"xyz 12"]
    raws = ["".join(r.choice(keys) for _ in range(60)) for _ in range(40)]

    def plain(t):
        out, i = "", 0
        while i < len(t):
            pair = t[i : i + 2]
            out, i = (out + code.pairs[pair], i + 2) if pair in code.pairs else (out + code.single.get(t[i], t[i]), i + 1)
        return out

    got = values(spark, F.struct(legacy.decoded(F.col("t"), code), legacy.encoded(legacy.decoded(F.col("t"), code), code)), [(x,) for x in raws], "t string")
    back = {v: k for k, v in code.single.items()} | {v: k for k, v in code.pairs.items()}
    assert [g[0] for g in got] == [plain(x) for x in raws]
    assert [g[1] for g in got] == ["".join(back.get(c, c) for c in plain(x)) for x in raws]


def test_text_rules(spark):
    rows = [("  a  b\t c­ß ",), ("",), ("Trang 12",), ("ABC 1",)]
    assert values(spark, text.clean_line(F.col("t")), rows, "t string") == ["a b c-ß", "", "Trang 12", "ABC 1"]
    assert values(spark, text.folded(F.col("t")), rows, "t string")[0] == "a b c­ss"
    assert values(spark, F.col("t").rlike(text.PAGE_NUMBER), rows, "t string") == [False, False, True, False]
    assert values(spark, text.is_upper(F.col("t")), rows, "t string") == [False, False, False, True]
    assert values(spark, text.error_rate(F.col("a"), F.col("b")), [("abc", "abd"), ("", ""), ("", "x"), ("Điều 1", "Dieu 1")], "a string, b string") == [1 / 3, 0.0, 1.0, 2 / 6]
    assert values(spark, text.safe_filename(F.col("t")), [("../a b/c?.pdf",)], "t string") == ["a_b_c.pdf"]
    assert values(spark, text.metric_key(F.lit("n"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), rows[:1], "t string") == ['n{a="1",b="2"}']
    assert values(spark, text.json_or_null(F.col("t"), "a int"), [('```json\n{"a": 1}\n```',), ("{",)], "t string")[0].a == 1
    assert values(spark, text.next_letter(F.col("t")), [("",), ("a",)], "t string") == ["a", "b"]


def test_boxes(spark):
    rows = [(10.0, 20.0, 110.0, 40.0, 600.0, 800.0), (5.0, 5.0, 5.0, 9.0, 600.0, 800.0), (0.0, 0.0, 0.1, 0.1, 600.0, 800.0)]
    args = [F.col(c) for c in ("x0", "y0", "x1", "y1", "w", "h")]
    schema = "x0 double, y0 double, x1 double, y1 double, w double, h double"
    assert values(spark, geometry.line_box(*args), rows, schema) == [[17, 25, 183, 50], None, [0, 0, 1, 1]]
    assert values(spark, geometry.margin_band(F.array(*(F.lit(v) for v in (0, 0, 9, 120)))), rows[:1], schema) == ["top"]
    assert values(spark, geometry.zone(F.col("y0"), F.col("h")), [(0, 200.0, 0, 0, 0, 800.0), (0, 600.0, 0, 0, 0, 800.0), (0, 300.0, 0, 0, 0, 800.0)], "x0 int, y0 double, a int, b int, c int, h double") == ["header", "signature", "body"]
    assert values(spark, geometry.span(F.lit(0.0), F.lit(20.0), F.lit([0.0, 10.0, 20.0, 30.0])), rows[:1], schema) == [2]


VIET = "Căn cứ Luật Tổ chức chính quyền địa phương, Ủy ban nhân dân tỉnh quyết định ban hành quy định về việc quản lý "


def test_triage(spark):
    rows = [("", 0.0, 0), (VIET, 0.0, 0), ("residue of ascii only text " * 5, 0.0, 0), ("footer only", 0.98, 0), (VIET, 0.0, 1), ("Céng hßa x· héi chñ nghÜa ViÖt Nam " * 3, 0.0, 0)]
    got = values(spark, triage.page_class(F.col("t"), F.col("i"), F.col("n")), rows, "t string, i double, n int")
    assert got == ["SCANNED", "DIGITAL_TEXT", "SCANNED", "SCANNED", "TABLE_HEAVY", "LEGACY_TEXT"]


def lines(spark, texts, **more):
    base = {"size": 14.0, "bold": True, "centered": False, "page": 1, "y": 0.0, "y1": 0.0, "x0": 0.0, "x1": 0.0} | more
    rows = [(1, i, t, *base.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, text string, size double, bold boolean, centered boolean, page int, y double, y1 double, x0 double, x1 double")


@pytest.mark.parametrize(
    "texts,kinds,demoted",
    [
        (["Điều 1. Một", "Điều 3. Ba"], ["article", "paragraph"], 1),
        (["Điều 1. A", "1. x", "2. y", "Điều 2. B", "1. z"], ["article", "clause", "clause", "article", "clause"], 0),
        (["Điều 1. A", "1. x", "a) y", "b) z"], ["article", "clause", "point", "point"], 0),
        (["Điều 1. A", "1. x", "c) y"], ["article", "clause", "paragraph"], 1),
        (["Điều 1. A", "1. x", "Chương II", "Điều 1. B", "2. q", "Chương III", "1. y"], ["article", "clause", "chapter", "article", "paragraph", "chapter", "paragraph"], 2),
        (["Căn cứ Luật", "1. x", "a) y", "Chương II", "Điều 1. A"], ["preamble_kw", "list_item", "list_item", "chapter", "article"], 0),
    ],
)
def test_hierarchy(spark, texts, kinds, demoted):
    found = structure.with_pattern(lines(spark, texts)).withColumn("kind", F.coalesce("kind", F.lit("paragraph")))
    got = structure.validated(found).orderBy("line_no").collect()
    assert [r.final_kind for r in got] == kinds and sum(r.demoted for r in got) == demoted
    assert all((r.confidence == 0.6) == r.demoted for r in got)


def numbered(rows):
    """(final kind, demoted) of one document's (kind, number, letter), by a plain loop."""
    state, article, clause, point, out = "FRONT_MATTER", 0, 0, "", []
    for kind, number, letter in rows:
        final, bad, in_body = kind, False, state == "BODY" and article > 0
        if kind == "chapter":
            state, article, clause, point = "BODY", 0, 0, ""
        elif kind == "article":
            state, bad = "BODY", number != article + 1
            if not bad:
                article, clause, point = number, 0, ""
        elif kind == "clause":
            if in_body and number == clause + 1:
                clause, point = number, ""
            elif not in_body and state == "PREAMBLE":
                final = "list_item"
            else:
                bad = True
        elif kind == "point":
            if state != "BODY" or not clause:
                final = "list_item"
            elif letter == (chr(ord(point) + 1) if point else "a"):
                point = letter
            else:
                bad = True
        state = {"preamble_kw": "PREAMBLE", "closing_kw": "CLOSING", "title": "FRONT_MATTER"}.get(kind, state)
        out.append(("paragraph" if bad else final, bad))
    return out


def test_hierarchy_of_many_chapters(spark):
    r = random.Random(3)
    kinds, weights = ["chapter", "article", "clause", "point", "paragraph", "title", "preamble_kw", "closing_kw", "heading"], [2, 8, 14, 14, 9, 1, 1, 1, 3]
    docs = {d: [(r.choices(kinds, weights)[0], r.choice([1, 1, 2, 2, 3]), r.choice("aabbc")) for _ in range(r.choice([1, 5, 60, 300]))] for d in range(40)}
    rows = [(d, n // 20, n, k, number, letter + ")") for d, found in docs.items() for n, (k, number, letter) in enumerate(found)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, line_no int, kind string, number int, marker string").repartition(4)
    got = {d: [] for d in docs}
    for x in structure.validated(frame).orderBy("doc_id", "page", "line_no").collect():
        got[x.doc_id].append((x.final_kind, x.demoted))
    assert got == {d: numbered(found) for d, found in docs.items()}


def test_points_make_a_list(spark):
    found = structure.with_pattern(lines(spark, ["Điều 1. A", "1. x", "a) y", "b) z", "2. w"])).withColumn("kind", F.coalesce("kind", F.lit("paragraph")))
    out = structure.point_lists(structure.validated(found).withColumn("bbox", F.array(F.col("line_no"), F.lit(1), F.lit(9), F.lit(9)))).collect()
    assert [(r["items"], r.marker, r.bbox) for r in out] == [(["a) y", "b) z"], "a)", [2, 1, 9, 9])]


def test_wrapped_lines(spark):
    rows = [(1, 0, "Quyết định này có", 0.0, 10.0), (1, 1, "hiệu lực", 12.0, 22.0), (1, 2, "xa.", 60.0, 70.0), (1, 3, "Điều 1. A", 71.0, 80.0)]
    df = spark.createDataFrame([(d, n, t, 14.0, False, False, 1, y, y1, 0.0, 50.0 + n) for d, n, t, y, y1 in rows], lines(spark, []).schema)
    out = structure.merge_wrapped(df).orderBy("line_no").collect()
    assert [(r.text, r.n_lines) for r in out] == [("Quyết định này có hiệu lực", 2), ("xa.", 1), ("Điều 1. A", 1)]
    assert df.agg(structure.baseline(F.col("size"), F.col("text"))).first()[0] == 14.0


BLOCKS = "doc_id long, page int, seq int, type string, text string, confidence double, bbox array<int>"


def test_cut_paragraphs(spark):
    rows = [(1, 1, 0, "open"), (1, 2, 1, "goes on"), (1, 2, 2, "and ends."), (1, 2, 3, "new"), (1, 3, 4, "more."), (2, 1, 0, "closed."), (2, 2, 1, "apart"), (2, None, 2, "last")]
    df = assembly.ordered(spark.createDataFrame([(d, p, s, "paragraph", t, 0.9, None) for d, p, s, t in rows], BLOCKS))
    got = [(r.doc_id, r.text) for r in assembly.join_cut_paragraphs(df).orderBy("doc_id", "position").collect()]
    assert got == [(1, "open goes on and ends."), (1, "new more."), (2, "closed."), (2, "apart"), (2, "last")]


def test_running_headers(spark):
    top, body = [0, 0, 9, 100], [0, 300, 9, 400]
    rows = [(1, 1, 0, "BỘ  Y TẾ", top), (1, 2, 1, "bộ y tế", top), (1, 1, 2, "same", body), (1, 2, 3, "same", body), (1, 2, 4, " 12 ", top), (1, 1, 5, "once", top)]
    df = spark.createDataFrame([(d, p, s, "paragraph", t, 0.9, b) for d, p, s, t, b in rows], BLOCKS)
    assert sorted(r.seq for r in assembly.strip_running(df).collect()) == [2, 3, 5]


def test_cut_tables_and_breaks(spark):
    low, high = [0, 500, 9, 900], [0, 100, 9, 400]
    rows = [(1, 1, 1, "table", low, 2, ["a"]), (1, 2, 2, "table", [0, 100, 9, 900], 2, ["a"]), (1, 3, 3, "table", high, 2, []), (1, 3, 4, "table", high, 2, ["b"])]
    df = spark.createDataFrame(rows, "doc_id long, page int, position int, type string, bbox array<int>, n_columns int, headers array<string>")
    assert [r.head_position for r in assembly.merge_cut_tables(df).orderBy("position").collect()] == [1, 1, 3, 4]
    rows = [(1, i, "section_break" if o else "paragraph", o) for i, o in enumerate(["l", "l", None, "l", "p", "p"])]
    df = spark.createDataFrame(rows, "doc_id long, position int, type string, orientation string")
    assert [r.position for r in assembly.drop_repeated_breaks(df).orderBy("position").collect()] == [0, 2, 3, 4]
    assert values(spark, assembly.list_markers(F.col("n"), F.col("m")), [(2, "c)"), (2, "1."), (0, "a)")], "n int, m string") == [["c)", "d)"], ["1.", "2."], []]


def test_ledger(spark):
    rows = [(1, "a b c", "c b a"), (2, "Abc  d", "ABC\td"), (3, "abc", "abd"), (4, "", ""), (5, None, "xx")]
    got = {r.pair_id: round(r.fidelity, 4) for r in fidelity.ledger(spark.createDataFrame(rows, "pair_id int, extracted string, docx string")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: round(1 - 2 / 3, 4), 4: 1.0, 5: 0.0}
    spans = fidelity.divergence(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)) + " w3", "z w3")], "pair_id int, extracted string, docx string")).orderBy("place").collect()
    assert [s.token for s in spans] == [f"w{i}" for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)]


def test_agreement_and_review(spark):
    df = spark.createDataFrame([(1, ["h", "p", "t"], ["p", "h", "t", "x"]), (2, [], [])], "doc_id long, pred array<string>, gold array<string>")
    got = {r.doc_id: (r.matched, round(r.f1, 4)) for r in fidelity.type_agreement(df).collect()}
    assert got == {1: (3, round(2 * 1 * 0.75 / 1.75, 4)), 2: (0, 0.0)}
    review = fidelity.pages_to_review(spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.6), (1, 2, 0.9)], "doc_id int, page int, confidence double")).collect()
    assert [(r.page, r.confidence, r.n_blocks) for r in review] == [(1, 0.55, 2)]
    new = fidelity.novelty(spark.createDataFrame([(1, "a b c d", "a b c x"), (2, "", "q")], "pair_id int, output string, source string")).collect()
    assert {r.pair_id: r.rate for r in new} == {1: 0.5, 2: 0.0}


def test_status(spark):
    rows = [(0, 1.0, 5, 10, 0.9, 1.0, 0, 3, False), (0, 0.9, 5, 10, 0.9, 1.0, 0, 3, False), (0, None, 0, 0, 0.9, 1.0, 0, 3, False), (0, 1.0, 5, 10, 0.9, 1.0, 1, 9, True), (0, 1.0, 0, 0, 0.9, 1.0, 1, 9, False), (0, 1.0, 5, 10, 0.7, 1.0, 0, 3, False)]
    names = ["r", "f", "b", "o", "c", "v", "d", "p", "x"]
    got = values(spark, triage.conversion_status(*(F.col(n) for n in names)), rows, "r int, f double, b int, o int, c double, v double, d int, p int, x boolean")
    assert [g.status for g in got] == ["completed", "completed_with_warnings", "failed", "failed", "completed_with_warnings", "completed_with_warnings"]


def test_quota_with_refunds(spark):
    log = [("charge", f"j{i}") for i in range(5)] + [("refund", "j0"), ("refund", "j0"), ("charge", "j9"), ("charge", "j10")]
    df = spark.createDataFrame([(1, i, op, "20240101", job) for i, (op, job) in enumerate(log)], "user_id int, ts int, op string, quota_key string, job_id string")
    got = operations.refunded_quota(df, 3).orderBy("ts").collect()
    assert [r.accepted for r in got] == [True, True, True, False, False, True, False, True, False]


def test_rate_limit_and_breaker(spark):
    at = [0, 10, 20, 100, 101, 160]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.in_window for r in operations.rate_limited(df, 60, 2).orderBy("event_id").collect()] == [1, 2, 3, 1, 2, 1]
    calls = [(0, False, True), (1, False, True), (2, True, True), (40, False, True), (50, True, True), (80, True, True)]
    df = spark.createDataFrame([("s", i, t, ok, c) for i, (t, ok, c) in enumerate(calls)], "service string, event_id long, s long, ok boolean, countable boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = operations.breaker_states(df, 2, 30.0).orderBy("event_id").collect()
    assert [(r.state, r.let_through) for r in got] == [("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True)]


def test_alerts_and_percentiles(spark):
    df = spark.createDataFrame([(1, i, i >= 4) for i in range(10)], "k int, seq int, bad boolean")
    got = operations.failure_alerts(df, ["k"], ["seq"], F.col("bad")).orderBy("seq").collect()
    assert got[3].failure_rate is None and not got[3].alert and got[9].failure_rate == 0.6 and got[9].alert
    p = operations.rank_percentiles(spark.createDataFrame([(1, float(v)) for v in range(20)] + [(1, None)], "k int, v double"), ["k"], "v").first()
    assert (p.n, p.p50, p.p95) == (20, 10.0, 19.0)


def test_zones_and_tables(spark):
    rows = ["UBND TỈNH", "SỞ Y TẾ", "CỘNG HÒA XÃ HỘI", "Độc lập - Tự do", "Số: 12/QĐ", "Hà Nội, 1 tháng 2 năm 2024", "text"]
    df = spark.createDataFrame([(1, 1, i, t, "left", "header") for i, t in enumerate(rows)], "doc_id long, page int, line_no int, text string, side string, zone string")
    head = zones.header_blocks(df).collect()
    assert [(r.country_name, r.document_number, r.superior_agency, r.issuing_agency, r.used) for r in head] == [("CỘNG HÒA XÃ HỘI", "Số: 12/QĐ", "UBND TỈNH", "SỞ Y TẾ", [0, 1, 2, 3, 4, 5])]
    assert [r.text for r in zones.body_lines(df, zones.header_blocks(df)).collect()] == ["text"]
    sig = [(1, 1, 0, "Nơi nhận:", "left"), (1, 1, 1, "TM. ỦY BAN", "right"), (1, 1, 2, "CHỦ TỊCH", "right"), (1, 1, 3, "Nguyễn A", "right"), (1, 2, 0, "x" * 50, "right")]
    df = spark.createDataFrame([(*r, "signature") for r in sig], "doc_id long, page int, line_no int, text string, side string, zone string")
    got = zones.last_signature(zones.signature_cues(df)).collect()
    assert [(r.page, r.authority, r.title, r.name) for r in got] == [(1, "TM. ỦY BAN", "CHỦ TỊCH", "Nguyễn A")]
    grid = spark.createDataFrame([(1, [[("a", 2, 1), ("b", 1, 2)], [("c", 1, 1), ("d", 1, 1)]])], "table_id long, rows array<array<struct<text:string,colspan:int,rowspan:int>>>")
    got = {r.text: (r.r, r.c, r.r_end, r.c_end) for r in inline.grid_places(grid).collect()}
    assert got == {"a": (0, 0, 0, 1), "b": (0, 2, 1, 2), "c": (1, 0, 1, 0), "d": (1, 1, 1, 1)}


def test_inline_runs(spark):
    got = values(spark, inline.runs(F.col("t")), [("Căn cứ Luật A",), ("theo Nghị định số 30/2020, xong",), ("plain",), ("",)], "t string")
    assert [[tuple(r) for r in g] for g in got] == [[("Căn cứ Luật A", True)], [("theo ", False), ("Nghị định số 30/2020", True), (", xong", False)], [("plain", False)], []]


def test_schema_diff(spark):
    need = spark.createDataFrame([("t", "a"), ("t", "b")], "table string, name string")
    have = spark.createDataFrame([("t", "a", False, False), ("t", "z", False, False), ("t", "y", True, False), ("u", "q", False, False)], "table string, name string, nullable boolean, has_default boolean")
    assert [r.name for r in schema_diff.missing_columns(need, have).collect()] == ["b"]
    assert [r.name for r in schema_diff.blocking_columns(need, have).collect()] == ["z"]
    keys = schema_diff.key_columns(spark.createDataFrame([("p", "t", "k", 2, "b"), ("p", "t", "k", 1, "a")], "kind string, table string, key string, place int, name string"))
    assert keys.first().columns == ["a", "b"] and schema_diff.missing_keys(keys.drop("key"), keys.drop("key")).isEmpty()
    assert [schema_diff.migration_state(1, 1, keys), schema_diff.migration_state(0, 0, keys), schema_diff.migration_state(0, 3, keys), schema_diff.migration_state(0, 3, keys.limit(0))] == ["already-migrated", "fresh", "incompatible", "compatible"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"blocks": [{"type": "heading", "text": "x", "confidence": 1.0}, {"type": "list", "items": [{"text": "y"}]}]}')
    got = blocks.read_documents(spark, str(tmp_path / "d.json")).orderBy("seq").collect()
    assert [(r.type, r.text) for r in got] == [("heading", "x"), ("list", None)] and got[1]["items"][0].text == "y"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"a": 1}\n{"a": \n')
    good, broken = blocks.read_records(spark, str(tmp_path / "r"), "a int")
    assert [r.a for r in good.collect()] == [1] and broken.count() == 1
    assert values(spark, blocks.unknown_keys(F.col("t"), ["a"]), [('{"a":1,"b":2}',)], "t string") == [["b"]]
    blocks.write_state(good, str(tmp_path / "s"), 3600)
    assert blocks.read_state(spark, str(tmp_path / "s")).count() == 1
    blocks.write_blocks(good.withColumn("n", F.lit(None).cast("int")), str(tmp_path / "b"))
    assert [r.value for r in spark.read.text(str(tmp_path / "b")).collect()] == ['{"a":1}']


def test_streams_agree_with_batch(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = lambda: jobs.read_stream(spark, f"{small}/events.parquet")
    batch = {(r.event_id, r.in_window) for r in operations.rate_limited(events, 43200, 2).collect()}
    assert {(r.event_id, r.in_window) for r in jobs.rate_limit(spark, f"{small}/events.parquet", 43200, 2).collect()} == batch
    kept = {r.event_id for r in operations.daily_quota(events, 2).where("admitted").collect()}
    assert {r.event_id for r in jobs.drained(jobs.watch_quota(stream(), 2)).collect()} == kept
    once = jobs.drained(jobs.watch_refunds(stream(), ["user_id", "event_type"])).select("user_id", "event_type")
    assert once.count() == once.distinct().count() == events.select("user_id", "event_type").distinct().count()


def test_service_rules(spark):
    from folioframe.functions import service

    calls = [("convert", "post"), ("convert", "GET"), ("convert/ab-1/report", "GET"), ("convert/a b", "GET"), ("admin", "GET"), ("settings/llm", "DELETE")]
    assert values(spark, service.route_status(F.col("p"), F.col("m")), calls, "p string, m string") == [200, 405, 200, 404, 404, 200]
    errors = [(401, ""), (500, "API key expired."), (500, "timeout"), (None, None)]
    assert values(spark, service.rejects_key(F.col("c"), F.col("t")), errors, "c int, t string") == [True, True, False, False]
    addresses = [("8.8.8.8",), ("10.1.2.3",), ("198.19.0.1",), ("256.1.1.1",), ("x",), (None,)]
    assert values(spark, service.is_global_ipv4(F.col("a")), addresses, "a string") == [True, False, False, False, False, False]
    payloads = [('{"provider":"gemini","model":"m","apiKey":"k"}',), ('{"provider":"gemini","model":3,"apiKey":"k"}',), ("[1]",), ("{",), (None,)]
    assert [bool(v) for v in values(spark, service.vision_settings(F.col("t")), payloads, "t string")] == [True, False, False, False, False]
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    assert values(spark, service.opened(service.sealed(F.col("a"), key), key), addresses[:2], "a string") == ["8.8.8.8", "10.1.2.3"]
    cells = spark.createDataFrame([(1, r, c, "x" if r or c else " ") for r in range(2) for c in range(2)] + [(2, r, 0, "x") for r in range(3)], "table_id int, row int, col int, text string")
    assert [r.table_id for r in triage.accepted_tables(cells).collect()] == [1]
    sides = spark.createDataFrame([(1, "gold", "image", "seal"), (1, "gold", "image", "seal"), (1, "pred", "image", "seal"), (2, "pred", "list", None)], "doc_id int, side string, type string, kind string")
    assert {r.doc_id: r.recall for r in fidelity.seal_recall(sides).collect()} == {1: 0.5, 2: 1.0}
    admitted = triage.admission(F.col("n"), F.col("s"), F.lit(True), F.lit(False), F.col("scan"), F.lit(False), F.col("q"), 100)
    uploads = [("a.PDF", 1, False, True), ("a.txt", 1, False, True), ("a.pdf", 101, False, True), ("a.pdf", 1, True, True), ("a.pdf", 1, False, False)]
    assert [v.status_code for v in values(spark, admitted, uploads, "n string, s int, scan boolean, q boolean")] == [202, 400, 413, 422, 429]
