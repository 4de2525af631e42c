"""Operator 11 against plain counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.llm import collocations as C


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: n for p, n in counts.items() if n >= 30}
        held = set()
        for p, n in often.items():
            for k in range(2, len(p)):
                held |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * n >= 80 * often[p[i : i + k]]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in held:
                score, k = min((2_000_000 * a // (often[p[:k]] + often[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:2000], 1)}
    return out


def got(frame):
    return {tuple(r) for r in C.collocations(frame).collect()}


def prose(seed, n=500, vocabulary=40):
    r = random.Random(seed)
    word = ["the", "THE", "of", "naïve", "中文", "a|b", "\xa0x", *(f"w{k}" for k in range(vocabulary))]
    weights = [30, 3, 20] + [8, 5, 4, 3] + [40 / (k + 1) for k in range(vocabulary)]
    rows = []
    for _ in range(n):
        text = "".join(r.choices(word, weights)[0] + r.choices([" ", "  ", "\t", ", ", ". ", "\n", "\x0c"], [60, 3, 2, 5, 4, 2, 1])[0] for _ in range(r.choice([0, 1, 3, 30, 60])))
        rows.append((r.choice(["en", "en", "en", "de", None]), text + r.choice(["", " very common line of five words", " very common"])))
    return rows + [("en", None), ("en", ""), (None, " .,"), ("fr", "x " * 100), ("es", "one two three four five " * 40)]


@pytest.mark.parametrize("bits,hot_words,flush", [(C.BITS, C.HOT, C.FLUSH), (64, C.HOT, 400), (C.BITS, 10**9, 3000)])
def test_against_plain_counts(spark, monkeypatch, bits, hot_words, flush):
    monkeypatch.setattr(C, "BITS", bits)
    monkeypatch.setattr(C, "FLUSH", flush)
    if hot_words > C.HOT:  # many hot words: phrases in parts
        monkeypatch.setattr(C, "HOT", hot_words)
        monkeypatch.setattr(C, "TASK_WORDS", 200)
    rows = prose(2)
    want = brute(rows)
    assert got(spark.createDataFrame(rows, "lang string, text string").repartition(3)) == want and len(want) > 40


@pytest.mark.parametrize("top,seeds", [(1, 1), (9, 1), (25, 2)])
def test_scores_bounded_by_first_and_last_words(spark, monkeypatch, top, seeds):
    monkeypatch.setattr(C, "TOP", top)
    monkeypatch.setattr(C, "SEEDS", seeds)
    rows = prose(5, 900)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert got(frame) == {r for r in brute(rows) if r[1] <= top}


@given(st.lists(st.integers(1, 1 << 50), min_size=1), st.booleans())
def test_levels_bound_from_below(n, hot):
    n = np.array(n)
    least = C.at_least(C.levels(n) | np.uint8(C.HOT_MARK * hot))
    assert (least <= n).all() and (least * 1.5 + 2 >= n).all()


def test_cases(spark, docs, rows, nothing):
    assert got(docs) == brute([(r[2], r[1]) for r in rows]) and got(nothing) == set()
    named = [(k, f"{k} is {k} is {k} is {k}, " * 20) for k in ("en", "de", "fr", "und", None)]  # words that are names of languages
    assert got(spark.createDataFrame(named, "lang string, text string")) == brute(named)
    clashing = docs.select("lang", "text", *(F.lit(1).alias(n) for n in "word h n bucket words hot ids counts phrase in_part total a l r k head tail rank score a.b".split()))
    assert got(clashing) == got(docs)
    one = [("en", "same words here and again, " * 20_000 + "z" * 500_000 + " tail of it")]
    assert got(spark.createDataFrame(one, "lang string, text string")) == brute(one)


@given(st.lists(st.text("ab  .\t\ncé", max_size=60), min_size=1, max_size=4), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_parts_of_long_texts(texts, limit):
    raw = [t.encode() for t in texts]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    found = []
    for i, j, part, bounds, counted in C.parts(offsets, data, limit):
        w = C.Words(part, bounds, np.zeros(j - i, np.uint64), counted)
        names = w.named(np.arange(len(w.h)))
        for k in np.flatnonzero(w.own).tolist():
            n = 1
            while n < 4 and k + n - 1 < len(w.follows) and w.follows[k + n - 1]:
                n += 1
            found.append(tuple(names[k : k + n]))
    want = [tuple(x.encode() for x in w[i : i + 4]) for t in texts for w in pieces(t) for i in range(len(w))]
    assert sorted(found) == sorted(want)


@given(st.lists(st.tuples(*[st.integers(1, 3)] * 4), min_size=1, max_size=60), st.integers(1, 6), st.sets(st.integers(1, 3)))
@settings(max_examples=200, deadline=None)
def test_quicksort(rows, least, hot):
    cut = [tuple(r[: 2 + r[0] % 3]) for r in rows]
    ids = np.array([[*r, 0, 0][:4] for r in cut]).T
    marks = np.isin(np.arange(4), list(hot))
    counts = Counter(r[:k] for r in cut for k in range(2, len(r) + 1))
    got = {tuple(ids[:d, at].tolist()): (n, part) for at, d, n, part in C.phrases(ids, np.ones(len(cut), np.int64), marks, least)}
    want = {p: (n, set(p) <= hot) for p, n in counts.items() if n >= least or set(p) <= hot}
    assert got == want
