"""Every registered query against its SQL, and the optional part's absence."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from folioframe.plans import rule_catalog as catalog


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _tidy(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, sql, name):
    got = catalog.QUERIES[name](spark, small)
    rows = got.collect()
    assert rows
    if name in catalog.ORACLES:
        out = sql.execute(catalog.ORACLES[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted((tuple(_tidy(v) for v in r) for r in out.fetchall()), key=repr)
        assert sorted((tuple(_tidy(r[c]) for c in names) for r in rows), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_part():
    code = "import sys; sys.modules['folioframe.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()) > 20, any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr
