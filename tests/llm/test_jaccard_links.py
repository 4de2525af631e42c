"""Operator 10 finds every link, also inside one component."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import jaccard_join
from tests.llm.test_duplicates import brute_sets, near_copies


def brute_degrees(rows):
    sets = {i: frozenset(brute_sets(t)) for i, t in rows}
    classes = set(sets.values()) - {frozenset()}
    degree = {x: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in classes) for x in classes}
    return {i: degree.get(x, 0) for i, x in sets.items()}


@pytest.mark.parametrize("block,tile_bytes,tile_docs", [(2000, 8 << 20, 2000), (15, 4000, 2000), (15, 8 << 20, 7)])
def test_degrees_in_large_clusters(spark, monkeypatch, block, tile_bytes, tile_docs):
    # these three are read on the driver, so that they reach the tasks
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", tile_docs)
    own = near_copies(3)
    own += [(i + 5000, t) for i, t in own[:20]]
    random.Random(1).shuffle(own)
    want = brute_degrees(own)
    got = {r.doc_id: r.n_links for r in jaccard_join.join(spark.createDataFrame(own, "doc_id long, text string").repartition(5)).collect()}
    assert got == want and max(want.values()) > jaccard_join.GROUP


@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(1, 4), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_prefixes_of_similar_sets_share_what_is_asked_for(seed, common, only_a, only_b, m_a, m_b):
    r = random.Random(seed)
    tokens = r.sample(range(1000), common + only_a + only_b)
    a, b = sorted(tokens[: common + only_a]), sorted(tokens[:common] + tokens[common + only_a :])
    size = lambda n, m: jaccard_join._length(n, m)
    if 100 * common < 80 * len(tokens) or size(len(a), m_a) > len(a) or size(len(b), m_b) > len(b):
        return
    shared = set(a[: size(len(a), m_a)]) & set(b[: size(len(b), m_b)])
    assert len(shared) >= jaccard_join._need(len(a), m_a, len(b), m_b) >= min(m_a, m_b)


def test_longer_prefixes_where_shingles_are_frequent():
    h = np.arange(1, 101, dtype=np.uint64)
    n, table = np.array([100]), np.zeros(jaccard_join.SLOTS, np.uint8)
    *_, length, asked = jaccard_join._ordered(np.zeros(100, np.int64), h, n, table)
    assert (length[0], asked[0]) == (21, 1)
    table[:] = 10
    *_, length, asked = jaccard_join._ordered(np.zeros(100, np.int64), h, n, table)
    assert asked[0] > 1 and length[0] == 20 + asked[0]
    table[90:] = 0  # the rare ones now come first, but are fewer than the shortest prefix
    _, first, length, asked = jaccard_join._ordered(np.zeros(100, np.int64), h, n, table)
    assert set(first[:11].tolist()) == set(range(90, 101)) and length[0] == 20 + asked[0]


def test_estimates_take_at_most_an_eighth_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLOTS", 64)
    often = spark.createDataFrame([(i, 8 if i < 40 else 1000) for i in range(46)], "a long, n long")
    table = jaccard_join._estimates(often)
    assert sorted(np.flatnonzero(table).tolist()) == [40, 41, 42, 43, 44, 45] and set(table[40:46]) == {10}


def test_one_shingle_in_unlike_texts_and_clashing_names(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    own = [(i, " ".join(["one", "very", "common", "short", "line"] + [word() for _ in range(4)])) for i in range(80)]
    own += [(200 + i, own[0][1]) for i in range(3)] + [(300, own[1][1] + " x"), (None, own[1][1]), (301, None), (302, "")]
    frame = spark.createDataFrame([(*x, 1, 2, 3) for x in own], "doc_id long, text string, `row` int, row_ int, __row int").repartition(4)
    want = brute_degrees([x for x in own if x[0] is not None])
    got = {x.doc_id: x.n_links for x in jaccard_join.join(frame).collect() if x.doc_id is not None}
    assert got == want
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == len(own) - 3 - (want[300] > 0)


@pytest.mark.parametrize("n", range(7))
def test_few_words_alone_in_a_chunk(spark, n):
    few = " ".join(f"w{k}" for k in range(n))
    data = np.frombuffer(few.encode(), np.uint8)
    row, h = jaccard_join.shingles(data, np.array([0, len(data)]))
    assert len(h) == (max(n - 4, 1) if n else 0)
    long_ = " ".join(f"v{k}" for k in range(60_000))  # a chunk of its own
    rows = [(1, few), (2, long_), (3, few), (4, long_)]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts, "doc_id")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame).collect()}
        assert got == {1: (len(h), 1), 3: (len(h), 1 if n else 3), 2: (59_996, 2), 4: (59_996, 2)}


def test_few_words_through_the_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(k, " ".join(["plain", "quiet", "garden", "walks", "near", "rivers"][:k]), "en", "s", 1) for k in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(7))
