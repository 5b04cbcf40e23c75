import os

import duckdb
import pytest

import __spark_entry__ as entry
from larder import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(float(v), 5) if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    want = db.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_part(spark, monkeypatch):
    monkeypatch.setattr(entry, "llm_queries", None)
    monkeypatch.setattr(entry, "corpus_pipeline", None)
    assert set(entry.queries()) == set(queries.QUERIES)


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 60, said.stderr[-500:]


def test_pages_with_cut_references_against_sql(spark, tmp_path):
    """Pages cut within a reference, references of references, others than the SQL's, and nulls."""
    texts = ["a &amp", "&amp;amp; &amp;copy; &copy;&middot;", "&quo", "&quot &quot;", "&lt;p&gt; &#38; &COPY; &am&copy;p;", "&", "", None, "no reference"]
    spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["html_unescape_pages"](spark, str(tmp_path))
    want = duckdb.sql(queries.SQL["html_unescape_pages"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'"))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
