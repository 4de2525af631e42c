"""What is registered: all thirteen operators and the pipeline, with their columns, over whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioframe.llm.queries import ORACLES as oracles

COLUMNS = {
    "op1_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3_": "doc_id held_out score predicted",
    "op4_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_": "page_id url text n_chars",
    "op8_": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_": "doc_id held_out score predicted",
    "op10_": "doc_id n_shingles component_id",
    "op12_": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_": "doc_id keep_id group_size kept text_sha256",
}


def test_columns_and_rows(spark, small):
    known = entry.queries()
    n = {t: spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("documents", "pages")}
    n["conversations"] = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
    tables = {"op6_": "pages", "op12_": "conversations"}
    for start, columns in COLUMNS.items():
        (name,) = [k for k in known if k.startswith(start)]
        out = known[name](spark, small)
        assert set(columns.split()) <= set(out.columns), name
        assert out.count() == n[tables.get(start, "documents")], name
    assert "pipeline" in known and set(known["op11_collocations"](spark, small).columns) == set("lang rank phrase a l r n score".split())


@pytest.mark.parametrize("name", sorted(oracles))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = entry.queries()[name](spark, small)
    out = con.execute(oracles[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(out.fetchall())
