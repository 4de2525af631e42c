"""Operators 1 and 10 against brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from folioframe.llm import jaccard_join, suffix_dedup


def brute_cut(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 100, bool)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        gone = gone[: len(b)]
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def passages(seed):
    """Passages around 100 bytes in many surroundings, periodic texts and copies."""
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcde é") for _ in range(n))
    common = [text(n) for n in (90, 99, 100, 101, 130, 260)]
    out = [text(r.randint(0, 150)) + r.choice(common) + text(r.randint(0, 150)) + r.choice(common) for _ in range(60)]
    out += ["ab" * r.randint(40, 120) for _ in range(6)] + ["z" * 500, text(3000)] + out[:5]
    return list(enumerate(out))


@pytest.mark.parametrize("hot", [2000, 10])
@pytest.mark.parametrize("flush", [24 << 20, 3000])
def test_suffix_dedup(spark, docs, rows, hot, flush, monkeypatch):
    # both are read on the driver, so that they reach the tasks
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(docs).collect()}
    assert got == brute_cut([(i, t) for i, t, *_ in rows])
    own = passages(hot + flush)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(spark.createDataFrame(own, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_cut(own)


def test_combining_in_a_task_changes_nothing():
    own = passages(1)
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in own]
    held = []
    for i, d in enumerate(data):
        row, start, n, h, g = suffix_dedup.runs(d, np.array([0, len(d)]))
        rec = np.zeros(len(row), suffix_dedup.RECORD)
        rec["h"], rec["g"], rec["doc"], rec["start"], rec["n"] = h, g, i, start, n
        held.append(rec)
    marks = {}
    for size in (1, 7, 100):
        rows = [b for k in range(0, len(held), size) for b in suffix_dedup.combine(np.concatenate(held[k : k + size]), 1)]
        flat = [x for b in rows for x in b.to_pylist()]
        packed = [suffix_dedup._records(x["body"]) for x in flat if x["kind"] == 0]
        flat = [x for x in flat if x["kind"]] + [x for b in suffix_dedup.settle(np.concatenate(packed), 1) for x in b.to_pylist()]
        marks[size] = {(x["doc"], s["start"]) for x in flat for s in np.frombuffer(x["body"], suffix_dedup.SPAN)}
    assert marks[1] and all(marks[1] >= marks[k] for k in marks)


def test_long_texts_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    long_ = "".join(r.choice("abcdefgh") for _ in range(1_300_000))
    own = [(1, long_), (2, long_[500_000:600_000]), (3, "x" + long_[524_100:524_600])]
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.digests(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert got[1][1] == 0 and got[2][1] == 100_000 and got[3][1] == 500


def test_cut_keeps_columns_and_repeated_rows(docs, nothing, spark):
    out = suffix_dedup.cut(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    assert suffix_dedup.cut(nothing).count() == 0
    r = random.Random(1)
    text = "".join(r.choice("abcd ") for _ in range(300))
    twice = suffix_dedup.cut(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in twice) == [(0, 300), (1, 0), (1, 0), (2, 0)]


def test_unlike_texts_of_one_id(spark):
    r = random.Random(2)
    a, b, c, d = ("".join(r.choice("abcd ") for _ in range(300)) for _ in range(4))
    own = [(None, a), (None, b), (3, a), (3, c + b), (4, c + d), (4, c + d), (2**63 - 1, d), (-(2**63) + 1, c[:50])]
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed) for x in suffix_dedup.digests(spark.createDataFrame(own, "doc_id long, text string")).collect()), key=str)
    want = [(None, 300, 0), (None, 300, 0), (3, 300, 300), (3, 600, 300), (4, 600, 300), (4, 600, 300), (2**63 - 1, 300, 300), (-(2**63) + 1, 50, 0)]
    assert got == sorted(want, key=str)


def brute_sets(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    out = []
    for size, copies in ((120, 40), (60, 25), (300, 20), (8, 10)):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                w[r.randrange(size)] = r.choice(words)
            out.append(" ".join(w))
    common = " ".join(r.choice(words) for _ in range(40))
    out += [common + " " + " ".join(r.choice(words) for _ in range(r.randint(2, 60))) for _ in range(60)]
    r.shuffle(out)
    return list(enumerate(out, 1000))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, docs, rows, seed):
    for own, frame in (([(i, t) for i, t, *_ in rows], docs), (near_copies(seed), None)):
        frame = frame or spark.createDataFrame(own, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame).collect()}
        assert got == brute_components(own)


def test_keep_one(spark, docs, nothing):
    frame = docs.unionByName(docs).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", *[c for c in docs.columns if c != "doc_id"]))
    kept = jaccard_join.keep_one(frame).collect()
    heads = {r.component_id for r in jaccard_join.join(docs).collect()}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(heads) and sum(r.doc_id is None for r in kept) == 1
    assert jaccard_join.keep_one(nothing).count() == 0 and jaccard_join.join(nothing).count() == 0


def test_suffix_buckets_fill_evenly():
    """Anchors are least hashes; the buckets must not be as crowded."""
    r = random.Random(4)
    data = np.frombuffer("".join(r.choice("abcdefgh ") for _ in range(200_000)).encode(), np.uint8)
    row, start, n, h, g = suffix_dedup.runs(data, np.array([0, len(data)]))
    rec = np.zeros(len(row), suffix_dedup.RECORD)
    rec["h"], rec["g"], rec["doc"], rec["start"], rec["n"] = h, g, 1, start, n
    packed = [x for b in suffix_dedup.combine(rec, 16) for x in b.to_pylist() if x["kind"] == 0]
    sizes = {x["bucket"]: len(suffix_dedup._records(x["body"])) for x in packed}
    assert len(packed) == len(sizes) == 16
    assert max(sizes.values()) < 1.3 * sum(sizes.values()) / 16
    assert all((np.diff(suffix_dedup._records(x["body"])["h"].astype(object)) > 0).all() for x in packed)
