"""Operators 2, 4, 5, 7 and 8 against brute-force versions."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import bpe, decontaminate, licenses, rules, sharding

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def items_of(texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return words


def test_decontamination(spark, docs, rows, nothing):
    words = items_of(None)
    texts = {i: t for i, t, *_ in rows}
    picked = [texts[20], texts[13][:300].upper(), "one", None, "", "a a", texts[20][50:200], "zz top never seen"]
    bench = spark.createDataFrame(list(enumerate(picked)), "item_id int, text string")
    windows = {}
    for i, t in enumerate(picked):
        w = words(t)
        for k in range(max(0, len(w) - 12) or (1 if w else 0)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = {}
    for i, t in texts.items():
        w, hit, items = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if k + n <= len(w) and (own := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    items |= own
        want[i] = (len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit) and 20 * len(hit) >= len(w))
    for block in (20_000, 3):
        got = {r[0]: tuple(r[1:]) for r in decontaminate.digest(decontaminate.contamination(docs, bench, block)).collect()}
        assert got == want
    assert sum(v[4] for v in want.values()) > 5
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0)).collect()} == {0}


def test_bpe_agrees_with_the_tokenizers_library(docs, rows, nothing):
    t = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in bpe.digests(docs, TOKENIZER).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == sha(b"".join(x.to_bytes(4, "little") for x in ids)), text
        assert got[i].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False).encode())
    assert {r.decoded for r in bpe.encode_decode(docs, TOKENIZER).collect()} == {x[1] or "" for x in rows}
    assert bpe.digests(nothing, TOKENIZER).count() == 0


def test_quality_rules(docs, rows, nothing):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    for i, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 1000 else {g for g in set(grams) if grams.count(g) > 1}
        rep = {k + d for k, g in enumerate(grams) if g in twice for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    orders = [list(rules.RULES), list(rules.RULES)[::-1]]
    a, b = ({(r.doc_id, r.kept) for r in rules.judge(docs, o).collect()} for o in orders)
    assert a == b
    assert rules.judge(nothing).count() == 0


def test_licenses(docs, rows, nothing):
    got = sorted((r.doc_id, r.line_no, r.license, round(r.dice, 9)) for r in licenses.scan(docs, 0.5).collect())
    want = []
    for i, text, *_ in rows:
        for k, line in enumerate((text or "").split("\n"), 1):
            a = set(licenses.bigrams(line))
            for name, t in licenses.TEMPLATES.items():
                b = set(licenses.bigrams(t))
                if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= 0.5:
                    want.append((i, k, name, round(d, 9)))
    assert got == sorted(want) and want
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize("n", [3, 16])
def test_sharding(docs, rows, nothing, n):
    got = sharding.shard(docs, n).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (sizes[i], zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    total, most = sum(sizes.values()), max(sizes.values())
    for k in range(n):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) <= most
    assert sharding.shard(nothing, n).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_of_one_hot_key(spark, monkeypatch, doc_id):
    hot = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("one and the same").alias("text"))
    others = spark.range(100, 4100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.lit("one and the same")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    seen, plain = [], sharding._per_range
    monkeypatch.setattr(sharding, "_per_range", lambda located: seen.append(plain(located)) or seen[-1])
    got = sharding.shard(hot.unionByName(others).repartition(5), 16).collect()
    assert len(got) == 24_000 and max(r.n for r in seen[-1]) < 500  # no task gets the key
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 17
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    ids = sorted(r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert ids == list(range(100, 4100))


def plain_finds(text, templates, percent=80):
    """All windows within the bounds that match, best first, without those that share words with an earlier one."""
    words, out = licenses.normalised(text or ""), []
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, t in templates.items():
        b, places = set(licenses.bigrams(t)), len(licenses.normalised(t)) - 1
        found = []
        for s, g in enumerate(grams):
            a = set()
            for e in range(s, min(s + places * (200 - percent) // percent, len(grams)) if g in b else s):
                a.add(grams[e])
                if grams[e] in b and 200 * len(a & b) >= percent * (len(a) + len(b)):
                    found.append((-2 * len(a & b) / (len(a) + len(b)), e - s, s + 1, e + 2, len(a), len(a & b)))
        taken = []
        for x in sorted(found):
            if all(x[2] > y[3] or y[2] > x[3] for y in taken):
                taken.append(x)
        out += [(name, *x[2:], -x[0]) for x in taken]
    return sorted(out)


def test_licenses_in_whole_texts(spark, docs, rows, nothing):
    mit, apache = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["Apache-2.0-header"]
    wrapped = "\n".join(" * " + apache[k : k + 60] for k in range(0, len(apache), 60))
    texts = [
        f"/*\n{apache}\n*/ code follows", "some words before " + mit + " and after it", mit.replace("software", "program", 2), "a paragraph that says: released under the MIT License. And so on for long, for long.",
        "zebra apple Released under the MIT License.", ("Released under the MIT License.\n" * 3) + "x", mit[:400], wrapped, None, "", "license", "Released under the\nMIT\n\nLicense", "MIT license MIT license MIT license",
    ]
    own = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, texts[1], 1, "x")]
    got = licenses.find(spark.createDataFrame(own, "doc_id long, text string, license int, w string").repartition(3)).collect()
    want = sorted((str(i), *f) for i, t, *_ in own for f in plain_finds(t, licenses.TEMPLATES))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == want
    assert {r.license for r in got if r.doc_id in (0, 1)} >= {"Apache-2.0-header", "MIT-text"}
    assert licenses.find(nothing).count() == 0
    assert sorted(tuple(r) for r in licenses.find(docs).collect()) == sorted((i, *f) for i, t, *_ in rows for f in plain_finds(t, licenses.TEMPLATES))


@pytest.mark.parametrize("size", range(2, 40))
def test_size_bounds_keep_matches_at_exactly_the_threshold(size):
    """Every text that reaches 0.8 has a marked word of the template, and whole numbers lose none at 0.8 itself."""
    template = " ".join(f"w{k}x" for k in range(size + 1))
    marked = set(licenses.marks(template, 0.8))
    grams = licenses.bigrams(template)
    free = sum(not marked & set(g.split()) for g in grams)
    assert 3 * free < 2 * len(grams)  # a match has two thirds of them at least


def damaged(text, rng, put_in, left_out):
    """A notice with so many words put in and left out, at random places."""
    words = text.split()
    for k in sorted(rng.sample(range(len(words)), left_out), reverse=True):
        del words[k]
    for k in range(put_in):
        words.insert(rng.randrange(len(words)), f"inserted{k}")
    return " ".join(words)


def test_damaged_notices_are_found_and_two_are_two(spark):
    """Notices with words put in or left out around the threshold, alone, in pairs and in rows of many, against all windows; no line that matches is missed."""
    rng = random.Random(7)
    apache, gpl, mit = (licenses.TEMPLATES[k] for k in ("Apache-2.0-header", "GPL-3.0-notice", "MIT-text"))
    block = "\n".join(apache.split("\n"))
    middle = apache.split()
    for n in (22, 26, 28, 30):  # as one run in the middle
        middle[40:40] = [f"word{k}" for k in range(n)]
        apache_with = " ".join(middle)
        middle = apache.split()
        assert any(f[0] == "Apache-2.0-header" for f in plain_finds(apache_with, licenses.TEMPLATES))
        block += "\n\n" + apache_with
    texts = [block, f"{apache} {apache}", f"{gpl}\n{apache}\n{gpl}", f"{mit} {mit} {mit}", " ".join(apache.split()[8:]) + " " + apache, apache + " " + " ".join(apache.split()[:-9]) + " " + apache]
    texts += [damaged(t, rng, i, o) for t in (apache, gpl) for i, o in ((5, 0), (12, 2), (20, 0), (0, 9), (3, 6), (40, 0))]
    texts += [" ".join(damaged(apache, rng, i % 7, i % 4) for i in range(9)), "Released under the MIT License. " * 40, "mit license the " * 300]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.find(own).collect()
    assert sorted(map(tuple, got)) == sorted((i, *f) for i, t in enumerate(texts) for f in plain_finds(t, licenses.TEMPLATES))
    n = lambda i, k: sum(r.doc_id == i and r.license == k for r in got)
    assert (n(0, "Apache-2.0-header"), n(1, "Apache-2.0-header"), n(3, "MIT-text"), n(4, "Apache-2.0-header")) == (5, 2, 3, 2)
    lines = spark.createDataFrame([(i, " ".join(t.split())) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(lines).collect()} <= {(r.doc_id, r.license) for r in got}


def test_licence_line_at_exactly_the_threshold(spark):
    rows = [(1, "zebra apple Released under the MIT License."), (2, "a b c d e f Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, {"MIT": licenses.TEMPLATES["MIT"]}).collect()
    assert [(r.doc_id, r.dice) for r in got] == [(1, 0.8)]


def test_rule_order_is_the_same_on_every_run(spark, docs):
    first = rules.ordered_rules(docs, 10_000)
    assert sorted(first) == sorted(rules.RULES) and all(rules.ordered_rules(docs.repartition(k), 10_000) == first for k in (1, 7))
    shouting = spark.createDataFrame([(i, " ".join("".join(chr(65 + int(c)) for c in f"{i}{k * 7919}") + "QWE" for k in range(200))) for i in range(50)], "doc_id long, text string")
    assert rules.ordered_rules(shouting, 1000)[0] == "shouting"
