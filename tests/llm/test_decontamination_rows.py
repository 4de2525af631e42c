"""Operator 2 judges row by row, with one block of the benchmark as with several."""

from folioframe.llm import decontaminate


def test_rows_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{c}{chr(97 + k)}" for k in range(20)) for c in "xy")
    a, b = a.replace("0", ""), b.replace("0", "")
    rows = [(1, a, "bad"), (1, "clean words", "good"), (None, b, "bad"), (None, "other words", "good"), (2, f"{a} {b}", "bad"), (3, None, "good"), (4, a, "bad"), (4, a, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    bench = spark.createDataFrame([(0, a), (1, b), (2, f"{a[-40:]} {b[:40]}"), (3, None)], "item_id int, text string")
    one, several = (sorted(map(str, decontaminate.contamination(docs, bench, n).collect())) for n in (10, 1))
    assert len(one) == len(rows) and several == one
    for n in (10, 1):
        left = decontaminate.clean(docs, bench, n)
        assert left.schema.names == docs.schema.names
        assert sorted(map(repr, ((r.doc_id, r.text, r.row) for r in left.collect()))) == sorted(repr(r) for r in rows if r[2] == "good")
