"""Null ids, nulls in any column, repeated rows and clashing names through every operator and stage; the pipeline against brute force."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import bpe, decontaminate, html_text, jaccard_join, licenses, quality, rules, sharding, suffix_dedup, toxicity
from folioframe.llm.oracles import DECONTAMINATION, JACCARD_JOIN

SMALL = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Names that operators might use for columns of their own.
CLASHES = (
    "row row_ __row bad_id doc label lo hi block other bodies rest kept words bare lines n x y a b c h g m bucket kind body start run token common need docs "
    "needs weight score predicted held_out size law shard slot grown_shard text_crc32 n_words n_hit n_items spans items contaminated ids decoded n_tokens rep "
    "node component_id n_links n_shingles x.y host path url_ key rng word bits slot_ total level old near up votes features quality toxic win at piece line"
).split()


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture(scope="module")
def odd(spark, tables):
    """The documents, some of them twice, some without an id, a text or anything."""
    docs = tables["documents"]
    some = docs.where("doc_id % 10 = 3")
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None), (7_000_001, None, "en", None, None)], docs.schema)
    frame = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(nulls)
    for i, name in enumerate(CLASHES):
        frame = frame.withColumn(name, F.lit(None).cast("string") if i % 3 == 0 else F.lit(i) if i % 3 == 1 else F.array(F.lit("x")))
    return frame.repartition(5).cache()


OPERATORS = {
    "suffix": lambda d, t: suffix_dedup.digests(d),
    "contamination": lambda d, t: decontaminate.digest(decontaminate.contamination(d, t["benchmark"])),
    "contamination in blocks": lambda d, t: decontaminate.digest(decontaminate.contamination(d, t["benchmark"], 7)),
    "quality": lambda d, t: quality.scored(d, t["labels"]),
    "bpe": lambda d, t: bpe.digests(d, TOKENIZER),
    "rules": lambda d, t: rules.judge(d, list(rules.RULES)),
    "licences": lambda d, t: licenses.find(d),
    "shards": lambda d, t: sharding.shard(d, n_shards=16).select("doc_id", "size", "text_crc32"),
    "toxicity": lambda d, t: toxicity.scored(d, t["labels"]),
    "jaccard": lambda d, t: jaccard_join.join(d),
}


def bag(frame):
    tidy = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    return Counter(tuple(tidy(v) for v in r) for r in frame.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(odd, tables, name):
    got = bag(OPERATORS[name](odd, tables))
    assert got == bag(OPERATORS[name](odd.select("doc_id", "text"), tables))
    if name != "licences":
        assert sum(got.values()) == odd.count()


def test_pages_with_other_columns(spark, tables):
    pages = tables["pages"].limit(60)
    nulls = spark.createDataFrame([(None, None, None), (None, "", ""), (1, None, "<p>x</p>"), (2, "no address", None)], pages.schema)
    pages = pages.unionByName(pages.where("page_id % 10 = 3")).unionByName(nulls).cache()
    wide = pages.select("*", *(F.lit(i).alias(n) for i, n in enumerate(CLASHES)), F.lit(1).alias("text"), F.lit("").alias("n_chars"))
    got = bag(html_text.extract(wide).select("page_id", "url", "text", "n_chars"))
    assert got == bag(html_text.extract(pages).select("page_id", "url", "text", "n_chars")) and sum(got.values()) == pages.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_other_columns(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    wide, narrow = stage(spark, odd, SMALL), stage(spark, odd.select(*plain), SMALL)
    if name == "bpe":
        assert bag(wide) == bag(narrow) and wide.count() == odd.count()
    else:
        assert wide.columns == odd.columns and narrow.columns == plain
        assert bag(wide.select(*plain)) == bag(narrow)
        assert narrow.where("doc_id is null").count() > 0
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def without_repeats(rows):
    """Texts without the bytes that a 100-byte string covers which starts earlier, by a set of strings seen."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 100, bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        out[i] = (b, gone[: len(b)])
    return out


def test_pipeline_against_brute_force(spark, tables):
    """Every stage after the classifier is done again with plain Python and SQL, and so is its effect on the next one."""
    docs = tables["documents"]
    kept = {r.doc_id for r in toxicity.scored(docs, tables["labels"]).where("predicted = 0").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}

    def asked(sql, texts):
        import pandas as pd

        frame = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})  # noqa: F841 (read by name below)
        con.execute("CREATE OR REPLACE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM frame")
        out = con.execute(sql)
        names = [c[0] for c in out.description]
        return [dict(zip(names, r, strict=True)) for r in out.fetchall()]

    heads = {r["component_id"] for r in asked(JACCARD_JOIN, texts)}
    cut = {i: bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") for i, (b, gone) in without_repeats([(i, texts[i]) for i in heads]).items()}
    assert any(len(cut[i].encode()) < len((texts[i] or "").encode()) for i in heads)
    clean = {r["doc_id"] for r in asked(DECONTAMINATION, cut) if not r["contaminated"]}
    assert 0 < len(clean) < len(heads) < len(kept) < docs.count()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.no_padding(), tokenizer.no_truncation()
    want = {}
    for i in clean:
        ids = tokenizer.encode(cut[i], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want
