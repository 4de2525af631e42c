"""Operator 13 against plain groups, with small limits so that every level is used."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.llm import grace_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = sha256(t.encode()).hexdigest()
        out.update((i, keep, len(ids), False, digest) for i in ids)
        out[(keep, keep, len(ids), False, digest)] -= 1
        out[(keep, keep, len(ids), True, digest)] += 1
    return +out


def got(frame):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in grace_dedup.groups(frame).collect())


@pytest.fixture(scope="module")
def own():
    r = random.Random(3)
    texts = [None, "", " ", "  \t", "a b", "a  b", "a\n\nb", " a b", "ä\x0b\x0cö", "ä ö", "\xa0a", "x" * 3000, "long " * 30_000]
    texts += [f"text {r.randrange(40)} {'y' * r.randrange(3)}" for _ in range(300)] + ["hot  text"] * 400 + ["hot text"] * 300
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[4]), (None, "only without id"), (None, "only without id"), (3, "one id, other text"), (-5, "hot text")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("flush,full,rows,size", [(16 << 20, 32 << 20, 1000, 32 << 20), (500, 32 << 20, 5, 32 << 20), (300, 600, 6, 200), (1, 100, 10**9, 10**12), (3000, 200, 3, 100)])
def test_against_plain_groups(spark, monkeypatch, own, flush, full, rows, size):
    for name, value in {"FLUSH": flush, "FULL": full, "PIECE_ROWS": rows, "PIECE_BYTES": size}.items():  # read on the driver
        monkeypatch.setattr(grace_dedup, name, value)
    assert got(spark.createDataFrame(own, "doc_id long, text string").repartition(4)) == brute(own)


def test_cases(spark, docs, rows, nothing):
    plain = [(r[0], r[1]) for r in rows]
    assert got(docs) == brute(plain) and grace_dedup.groups(nothing).count() == 0
    clashing = docs.select("doc_id", "text", *(F.lit(1).alias(n) for n in "doc slot leader kind first n h size sha keep_id kept bucket hot piece a.b".split()))
    assert got(clashing) == brute(plain)
    assert sorted(r.doc_id for r in grace_dedup.keep_one(docs).collect()) == sorted(k[0] for k in brute(plain) if k[3])


@given(st.lists(st.sampled_from([b"", b"a", b"b", b"aa", b"ab", b"c" * 50]), min_size=1, max_size=40), st.integers(0, 2))
def test_table_compares_contents_where_hashes_agree(texts, bits):
    h = np.array([len(t) & bits for t in texts], np.uint64)  # hardly any hash at all
    assert [texts[k] for k in grace_dedup.owners(h, texts)] == texts
    assert grace_dedup.owners(h, texts).tolist() == [texts.index(t) for t in texts]
