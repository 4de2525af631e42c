"""Operators 3, 6 and 9, and the pipeline."""

import html as entities
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import bpe, decontaminate, html_text, jaccard_join, quality, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")}


@pytest.mark.parametrize("op,column,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(tables, op, column, least):
    out = op.scored(tables["documents"], tables["labels"])
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == tables["documents"].count()
    rows = out.join(tables["labels"], "doc_id").where("held_out").select("predicted", "score", column).collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[column] for r in rows) >= least * len(rows)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edge_rows(docs, nothing, tables, op, rows):
    out = op.scored(docs.unionByName(docs), tables["labels"]).collect()
    assert len(out) == 2 * len(rows) and all(r.score is not None for r in out)
    assert op.scored(nothing, tables["labels"]).count() == 0
    assert {r.predicted for r in op.scored(docs, tables["labels"].limit(0)).collect()} <= {0, 1}


def test_label_model_finds_accuracies_without_labels():
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.2
    votes = np.stack([np.where(r.random(20000) < acc, np.where(y, 1, -1), np.where(y, -1, 1)) for acc in (0.95, 0.9, 0.85, 0.8)] + [np.zeros(20000, int)], 1)
    votes[:, 4] = votes[:, 3]  # a copy of another voter counts once
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(pattern, n.astype(float))
    assert abs(model.prior - 0.2) < 0.05
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def test_discriminant_against_plain_formula():
    r = np.random.default_rng(2)
    x = {0: r.normal(0, 2, (500, 3)), 1: r.normal(1, 0.5, (800, 3))}
    model = quality.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    assert (model.score(x[1]) > 0.5).mean() > 0.85 and (model.score(x[0]) < 0.5).mean() > 0.8
    assert set(quality.Discriminant({1: (5.0, np.ones(3), np.eye(3))}).score(x[0])) == {0.5}


def test_pages_against_their_article(tables):
    got = {r.page_id: r for r in html_text.extract(tables["pages"]).collect()}
    for r in tables["pages"].collect():
        own = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", own)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_page_cases(spark):
    page = lambda body: f"<html><head><title>t</title></head><body><div class='top-banner'>Sale</div><div class=x><p>About our site</p></div>{body}<section id=comments><p>first!</p></section><script>if(a<b)</script><!-- no --><aside>side</aside><form><p>mail</p></form></body></html>"
    rows = [
        (1, "http://a.b/1", page("<div><h2>One</h2><p>alpha &amp; beta<br>gamma<p>next   <i>word</i>s</div>")),
        (2, "http://a.b/2", page("<div><h2>Two</h2><p>quite another story of many words</p></div>")),
        (3, "http://A.b/3", page("<div><h2>Three</h2><p>yet another one with its own words</p></div>")),
        (8, "http://a.b/8", page("<div><h2>Four</h2><p>something else again, and at some length</p></div>")),
        (4, "http://c.d/", "<p>cut &lt;off"),
        (5, None, None),
        (6, "http://e.f/", ""),
        (7, "http://a.b/7", "plain < text"),
    ]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "One\nalpha & beta gamma\nnext words"
    assert got[2] == "Two\nquite another story of many words"
    assert (got[4], got[5], got[6], got[7]) == ("cut <off", "", "", "plain < text")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_large_hosts_meet_in_several_groups(spark, tables, monkeypatch):
    monkeypatch.setattr(html_text, "LARGE", 5)
    monkeypatch.setattr(html_text, "PER_GROUP", 4)
    plain = lambda: {(r.page_id, r.text) for r in html_text.extract(tables["pages"]).collect()}
    parted = plain()
    monkeypatch.undo()
    assert parted == plain()


def test_pipeline_stages(spark, tables):
    docs = tables["documents"]
    names = docs.columns
    d = "/root/testdata/sf0.01"
    steps = dict(corpus_pipeline.STAGES)
    assert [*steps] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "bpe"]
    out = steps["toxicity"](spark, docs, d).cache()
    bad = {r.doc_id for r in toxicity.scored(docs, tables["labels"]).where("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    one = steps["near_duplicates"](spark, out, d).cache()
    groups = jaccard_join.join(out).groupBy("component_id").agg(F.min("doc_id").alias("m")).collect()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.m for r in groups)
    cut = steps["suffix_dedup"](spark, one, d).cache()
    kept = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.digests(one).collect()}
    assert all(0 <= kept[r.doc_id] - len(r.text.encode()) <= 12 * (kept[r.doc_id] > 0) + 300 * 0 + kept[r.doc_id] * 0.05 for r in cut.collect())
    clean = steps["decontamination"](spark, cut, d).cache()
    found = decontaminate.contamination(cut, tables["benchmark"]).where("contaminated").collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - {r.doc_id for r in found}
    assert {r.doc_id for r in decontaminate.clean(cut, tables["benchmark"], 7).collect()} == {r.doc_id for r in clean.collect()}
    assert all(x.columns == names for x in (out, one, cut, clean))
    last = steps["bpe"](spark, clean, d)
    assert sorted(last.collect()) == sorted(bpe.digests(clean, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {r.doc_id for r in clean.collect()}


def test_names_inside_articles_and_hosts_of_two_pages(spark):
    page = lambda x, extra="": f"<body><div><p>Acme shop, open daily</p></div><article><h1>{x}</h1><p>words on {x} only</p>{extra}</article><div><p>All rights reserved</p></div></body>"
    inner = "<div class='side-effects'><p>Side effects of the drug</p></div><div class='reply header-note'><p>kept too</p></div><div class='comments big'><p>first!</p></div><div class=ad><p>buy</p></div>"
    loose = lambda x: f"<body><div><p>Acme shop, open daily</p></div><div><p>{x} is what this page is about, at length</p></div></body>"
    rows = [(1, "http://a/1", page("one", inner)), (2, "http://a/2", page("two")), (3, "http://b/1", loose("first")), (4, "http://b/2", loose("second"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "one\nwords on one only\nSide effects of the drug\nkept too"
    assert got[2] == "two\nwords on two only"
    assert got[3] == "first is what this page is about, at length" and got[4] == "second is what this page is about, at length"


def test_discriminant_equals_densities_written_out():
    r = np.random.default_rng(4)
    x = {0: r.normal(0, 2, (300, 4)) @ r.normal(0, 1, (4, 4)), 1: r.normal(1, 0.5, (200, 4))}
    model = quality.Discriminant({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()})
    covs = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = 0.6 * covs[0] + 0.4 * covs[1]
    scale = np.sqrt(np.diag(pooled) + 1e-9)
    points, log = np.vstack([x[0], x[1]]), []
    for k in (0, 1):
        cov = ((1 - quality.POOLED - quality.UNIT) * covs[k] + quality.POOLED * pooled) / np.outer(scale, scale)
        cov = cov + (quality.UNIT * np.trace(cov) / 4 + 1e-6) * np.eye(4)
        z = (points - x[k].mean(0)) / scale
        log.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1])
    diff = quality.TEMPER * (log[1] - log[0]) + np.log(0.4 / 0.6)
    assert np.allclose(model.score(points), 1 / (1 + np.exp(-np.clip(diff, -60, 60))), atol=1e-9)


def test_label_model_posterior_equals_bayes_rule_written_out():
    r = np.random.default_rng(5)
    votes = r.integers(-1, 2, (400, 4))
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(pattern, n.astype(float), rounds=7)
    for row, got in zip(pattern, model.posterior(pattern), strict=True):
        p = [1 - model.prior, model.prior]
        for j, par in enumerate(model.parent):
            for c in (0, 1):
                p[c] *= model.tables[j][c][row[par] + 1 if par is not None else 0, row[j] + 1]
        assert np.isclose(got, p[1] / sum(p))
