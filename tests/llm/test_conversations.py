"""Operator 12 against all edit sequences, and with blocks of a few rows."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.llm import conversations as C


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        how, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        mine = out.setdefault(conv, [])
        if how:
            text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
            mine += [(turn, "user" if how == 4 else role, text)] * (1 + (how == 3))
    return out


def brute(rows):
    """All edits, with the least cost and then the least audit kept for each pattern state: no crossings, audits as strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def put(to, q, new):
        if q not in to or new[:2] < to[q][:2]:
            to[q] = new

    def inserted(now):
        out = dict(now)
        for _ in range(3):
            for p, (c, a, b) in list(out.items()):
                for role in ("user", "assistant"):
                    if (p, role[0]) in step:
                        put(out, step[p, role[0]], (c + 2, a + "I", (*b, f"{role}:")))
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for p, (c, a, b) in inserted(best).items():
            put(new, p, (c + 3, a + "D", b))
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if (p, role[:1]) in step:
                    put(new, step[p, role[:1]], (c, a + "K", (*b, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (p, other[0]) in step:
                        put(new, step[p, other[0]], (c + 2, a + "R", (*b, f"{other}:{text}")))
        best = new
    cost, audit, left = min(v for p, v in inserted(best).items() if p in ("", "a"))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = Counter(faults)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in pairwise(rows))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()


ROW = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", " "]), st.sampled_from(["Yes.", "No!", "cut off", "", " \n", "Why? ", "ä…", "Fine."]), st.integers(0, 9))


@given(st.lists(ROW, max_size=14))
@settings(max_examples=400, deadline=None)
def test_crossings_give_the_least_audit(rows):
    own = [(i, role, f"{n}{text}" if text.strip() else text) for i, (role, text, n) in enumerate(rows)]
    tail = lambda t: 1 if not t.strip(" \t\n\x0b\x0c\r") else 0 if t.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else 3
    assert C.repair([(*r, tail(r[2])) for r in own]) == brute(own)


def many(seed=1):
    r = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(r.choice([0, 1, 2, 5, 9]) if conv else 300):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn if r.random() < 0.95 else None, "system" if r.random() < 0.05 else role, r.choice(["Same line.", f"Line {turn}.", f"cut {turn}", "", None])))
    rows += [(None, 1, "user", "Hi."), (None, 2, None, None), (61, None, None, None), (62, 3, "tool", "x.")]
    return rows + rows[5:9]


SCHEMA = "conv_id long, turn long, role string, text string"


def got(frame):
    return {x.conv_id: tuple(x)[1:] for x in C.damaged_repairs(frame).collect()}


@pytest.mark.parametrize("block,parts", [(1024, 4), (7, 3), (1, 9)])
def test_blocks(spark, monkeypatch, block, parts):
    run = C._runs

    def small(kind):
        out, schema = run(kind)
        out.__globals__["BLOCK"] = block
        return out, schema

    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "_runs", small)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = many()
        frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert got(frame) == {c: brute(r) for c, r in damage(rows).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cases(spark):
    rows = [(i, None, None, None) for i in range(30)] + [(40, t, "user", "Same.") for t in range(50)] + [(41, 0, "user", "long " * 300_000 + ".")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame) == {c: brute(r) for c, r in damage(rows).items()}
    wide = frame.select("*", *(F.lit(1).alias(n) for n in "how place number fault part block at conv kind cost audit a.b".split()))
    assert got(wide) == got(frame)
    assert got(frame.limit(0)) == {}
    named = frame.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert len(got(named)) == 32
    assert {x.conv_id: tuple(x)[1:] for x in C.repairs(frame).collect()} == {c: brute([(t, r or " ", x or " ") for d, t, r, x in rows if d == c]) for c in {r[0] for r in rows}}
