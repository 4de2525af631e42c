"""Decisions that follow from earlier ones, against plain loops; changes to tables, vision results and records."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import assembly, blocktext, changes, registry, structure, styles, vision, zones
from folioframe.sources import files

BLOCKS = "doc_id long, page int, seq int, type string, text string, confidence double, runs array<string>"


def plain_join(blocks):
    out = []
    for page, kind, text, confidence, runs in blocks:
        head = out[-1] if out else None
        if head and head[1] == kind == "paragraph" and (page or 0) == (head[0] or 0) + 1:
            before = (head[2] or "").rstrip()
            if before and before[-1] not in '.:;!?"':
                head[2:5] = [f"{before} {(text or '').strip()}".strip(), min(head[3], confidence), []]
                continue
        out.append([page, kind, text, confidence, runs])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cut_paragraphs_against_a_loop(spark, seed):
    r = random.Random(seed)
    docs = {}
    for d in range(60):
        pages = sorted(r.choices([1, 2, 3, 4, 5, 6, 8], k=r.randint(1, 12))) + [None] * r.randint(0, 2)
        docs[d] = [(p, r.choices(["paragraph", "table"], [9, 1])[0], r.choices(["a b", " c ", "end.", "", None, "q?"], [8, 3, 2, 1, 1, 1])[0], r.random(), ["x"]) for p in pages]
    rows = [(d, p, i, k, t, c, x) for d, own in docs.items() for i, (p, k, t, c, x) in enumerate(own)]
    got = assembly.join_cut_paragraphs(assembly.ordered(spark.createDataFrame(rows, BLOCKS))).orderBy("doc_id", "position").collect()
    for d, own in docs.items():
        assert [[x.page, x.type, x.text, x.confidence, x.runs] for x in got if x.doc_id == d] == plain_join(own)


def plain_merge(lines):
    out, height = [], 1.0
    for text, size, bold, centered, page, y, y1, x1 in lines:
        head = out[-1] if out else None
        before = head[0].rstrip() if head else ""
        joins = before and not text.startswith("Điều 1") and before[-1] not in '.:;!?"' and head[4] == page and head[3] == centered and abs(size - head[1]) <= 1.5 and y - head[6] < 1.6 * height
        joins = joins and not (centered and len(text.strip()) < 60 and (bold or text.strip() == text.strip().upper()))
        height = max(y1 - y, 1.0)
        if joins:
            head[0], head[1], head[2], head[6], head[7], head[8] = f"{before} {text.strip()}", max(head[1], size), head[2] or bold, y1, max(head[7], x1), head[8] + 1
        else:
            out.append([text, size, bold, centered, page, y, y1, x1, 1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_wrapped_lines_against_a_loop(spark, seed):
    r = random.Random(seed)
    docs = {}
    for d in range(40):
        y, own = 0.0, []
        for i in range(r.randint(1, 25)):
            y += r.choice([11.0, 12.0, 30.0])
            own.append((r.choices(["so it goes", " on and on ", "and ends.", "Điều 1 x", "MORE"], [6, 3, 1, 1, 1])[0], r.choice([12.0, 13.0, 14.0, 14.5]), r.random() < 0.2, r.random() < 0.1, i // 9, y, y + 10, r.random()))
        docs[d] = own
    rows = [(d, i, *x) for d, own in docs.items() for i, x in enumerate(own)]
    frame = spark.createDataFrame(rows, "doc_id long, line_no int, text string, size double, bold boolean, centered boolean, page int, y double, y1 double, x1 double")
    got = structure.merge_wrapped(frame).orderBy("doc_id", "page", "line_no").collect()
    for d, own in docs.items():
        assert [[x.text, x.size, x.bold, x.centered, x.page, x.y, x.y1, x.x1, x.n_lines] for x in got if x.doc_id == d] == plain_merge(own)


def test_assembly_in_its_order(spark):
    top, low, high, body = [0, 0, 9, 100], [0, 500, 9, 900], [0, 100, 9, 400], [0, 300, 9, 400]
    rows = [
        (2, "table", None, high, 2, [], None, None), (1, "paragraph", "Header", top, 0, [], None, None), (1, "image", None, [0, 760, 9, 900], 0, [], None, "seal"), (1, "paragraph", "cut", body, 0, [], None, None),
        (2, "paragraph", "header", top, 0, [], None, None), (None, "section_break", None, None, 0, [], "landscape", None), (None, "section_break", None, None, 0, [], "landscape", None),
        (3, "paragraph", "whole.", body, 0, [], None, None), (4, "paragraph", "12", top, 0, [], None, None),
    ]
    frame = spark.createDataFrame([(1, p, i, k, t, 0.9, b, n, h, o, g, None) for i, (p, k, t, b, n, h, o, g) in enumerate(rows)], "doc_id long, page int, seq int, type string, text string, confidence double, bbox array<int>, n_columns int, headers array<string>, orientation string, kind string, anchor_block string")
    got = assembly.assembled(frame).orderBy("position").collect()
    assert [(x.type, x.text) for x in got] == [("image", None), ("paragraph", "cut"), ("table", None), ("paragraph", "whole."), ("section_break", None)]
    assert got[0].anchor_block == "signature" and [x.head_position for x in got] == [x.position for x in got]


def test_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    take = lambda df: sorted((x.k, x.v) for x in df.collect())
    assert sorted(map(str, take(changes.upsert(table, rows, ["k"])))) == ["(1, 'a')", "(2, None)", "(3, 'c')"]
    assert take(changes.create_absent(table, rows, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert take(changes.delete(table, rows, ["k"])) == [(1, "a")]
    assert take(changes.update_where(table, F.when(F.col("k") == 1, F.lit(True)), v=F.lit("z"))) == [(1, "z"), (2, "b")]
    assert changes.the_only(table, F.col("k") == 1).first().v == "a"
    for condition in (F.col("k") > 0, F.col("k") > 5):
        with pytest.raises(ValueError):
            changes.the_only(table, condition)


def test_vision_results(spark):
    asked = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 9)], "doc_id long, batch long, page long")
    got = spark.createDataFrame([(1, 0, 0, None, 0.5), (1, 0, 1, 1, 0.99), (1, 0, 2, 9, 0.9), (1, 1, 3, None, 1.0)], "doc_id long, batch long, seq int, page long, confidence double")
    kept, dropped = vision.accepted_blocks(got, asked)
    assert sorted((x.seq, x.page, x.confidence) for x in kept.collect()) == [(1, 1, 0.95), (3, 9, 0.95)]
    assert sorted((x.seq, x.reason) for x in dropped.collect()) == [(0, "no page"), (2, "wrong page")]
    assert [x.page for x in vision.missing_pages(kept, asked).collect()] == [2]


def test_records(spark):
    jobs = spark.createDataFrame([(1, i, s) for i, s in enumerate(["done", "open", "done", "open", "done"])], "u int, i int, s string")
    assert sorted(x.i for x in registry.evicted(jobs, ["u"], ["i"], F.col("s") == "done", 3).collect()) == [1, 3, 4]
    assert sorted(x.i for x in registry.evicted(jobs, ["u"], ["i"], F.col("s") == "done", 1).collect()) == [1, 3]
    probes = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "k string, ok boolean")
    assert {x.k: x.status for x in registry.readiness(probes, ["k"], F.col("ok")).collect()} == {"a": "degraded", "b": "ok"}
    assert [x.text for x in styles.instructions(spark.createDataFrame([("signature", "name", "an a"), ("image", "x", "b")], "block_type string, field string, text string")).orderBy("text").collect()] == ["AN A", "b"]
    lines = spark.createDataFrame([(1, 1, i, float(-i), 0.0) for i in range(4)], "doc_id long, page int, line_no int, y double, x0 double")
    used = lines.where("line_no = 2")
    assert [x.line_no for x in zones.restored(lines, used, lines.where("line_no = 0")).orderBy("position").collect()] == [3, 1]


def test_block_text_of_missing_fields(spark):
    side = "struct<superior_agency:string,issuing_agency:string,document_number:string,receipt_list:array<string>>"
    other = "struct<country_name:string,motto:string,location_and_date:string,authority:string,title:string,name:string>"
    cells = "array<array<struct<text:string>>>"
    schema = f"type string, text string, items array<struct<text:string>>, headers {cells}, rows {cells}, left {side}, right {other}, label string"
    rows = [("paragraph", None, None, None, None, None, None, None), ("list", None, [(" a ",), (None,)], None, None, None, None, None), ("table", None, None, None, [[("x",), ("y",)]], None, None, None), ("signature", None, None, None, None, (None, None, None, ["r"]), (None, None, None, "TM. A", None, "N"), None), ("image", "no", None, None, None, None, None, None)]
    got = spark.createDataFrame(rows, schema).select(blocktext.block_text(F.struct("*")).alias("t"), blocktext.content_chars(F.struct("*")).alias("n")).collect()
    assert [(x.t, x.n) for x in got] == [("", 0), (" a  ", 1), ("x y", 2), ("r TM. A N", 7), ("", 0)]


def test_files_by_age(spark, tmp_path):
    for name, age in (("conv_1.pdf", 100), ("conv_2.pdf", 50), ("conv_3.pdf", 10), ("other.txt", 100)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_700_000_000 - age,) * 2)
    old = registry.expired(files.listing(spark, str(tmp_path), "conv_*.pdf"), 50, F.timestamp_seconds(F.lit(1_700_000_000)))
    assert sorted(os.path.basename(r.path) for r in old.collect()) == ["conv_1.pdf", "conv_2.pdf"]
