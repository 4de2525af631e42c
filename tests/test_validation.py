"""Errors of block JSON, with their paths."""

import json

from folioframe.operators.validation import checked


def errors(spark, *chunks):
    rows = [(i, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(chunks)]
    got = {r.chunk_id: (r.n_blocks, r.errors) for r in checked(spark.createDataFrame(rows, "chunk_id long, json string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_paths_and_order(spark):
    good = {"type": "heading", "confidence": 0.5, "level": 2, "text": "x", "align": None, "page": 1, "bbox": [0, 0, 10, 1000]}
    got = errors(
        spark,
        [good],
        {"blocks": [good, good | {"level": 7, "page": 0, "confidence": 1.5}]},
        [{"type": "heading", "extra": 1, "also": 2, "text": 3}],
        [{"type": "poem"}, {"confidence": 1}, 5],
        [{"type": "table", "confidence": 1, "rows": [[{"text": "a"}, {"colspan": 0, "bold": "x"}], 3]}],
        [{"type": "image", "confidence": 0.1, "kind": "cat", "bbox": [0, 0, 0, 5]}, {"type": "illegible", "confidence": 0, "bbox": [1, 2, 3]}],
        [{"type": "list", "confidence": 1, "items": []}, {"type": "list", "confidence": 1, "items": [{"text": "a", "runs": [{"text": None}]}]}],
        "not json",
        "3",
        [],
        [{"type": "heading"}] * 6,
        [{"type": "signature", "confidence": 1, "left": {"receipt_list": ["a", 1]}, "right": {"name": None, "x": 1}}],
    )
    at = "block blocks."
    assert got[0] == (1, []) and got[9] == (0, [])
    assert got[1] == (2, [f"{at}1.heading.confidence: Input should be less than or equal to 1", f"{at}1.heading.page: Input should be greater than or equal to 1", f"{at}1.heading.level: Input should be less than or equal to 6"])
    assert got[2][1] == [f"{at}0.heading.{x}" for x in ("confidence: Field required", "level: Field required", "text: Input should be a valid string", "also: Extra inputs are not permitted", "extra: Extra inputs are not permitted")]
    assert got[3][0] == 3 and "Input tag 'poem' found using 'type'" in got[3][1][0] and got[3][1][1:] == [f"{at}{i}: Unable to extract tag using discriminator 'type'" for i in (1, 2)]
    assert got[4][1] == [f"{at}0.table.rows.{x}" for x in ("0.1.colspan: Input should be greater than or equal to 1", "0.1.bold: Input should be a valid boolean", "1: Input should be a valid list")]
    assert got[5][1] == [
        f"{at}0.image.bbox: Value error, bbox [0, 0, 0, 5] out of range: need 0<=x0<x1<=1000 and 0<=y0<y1<=1000",
        f"{at}0.image.kind: Input should be 'seal', 'stamp', 'signature', 'photo' or 'diagram'",
        f"{at}1.illegible.bbox: Value error, bbox must have exactly 4 integers [x0, y0, x1, y1]",
    ]
    assert got[6][1] == [f"{at}0.list.items: List should have at least 1 item after validation, not 0", f"{at}1.list.items.0.runs.0.text: Input should be a valid string"]
    assert got[7][1] == ["empty response: expected a JSON array of blocks"] and got[8][1] == ["expected a JSON array of blocks"]
    assert got[10][0] == 6 and got[10][1] == [f"{at}{i}.heading.{f}: Field required" for i in range(6) for f in ("confidence", "level", "text")][:10]
    assert got[11][1] == [f"{at}0.signature.left.receipt_list.1: Input should be a valid string", f"{at}0.signature.right.x: Extra inputs are not permitted"]
