"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from textquarry.catalog import TABLES
from textquarry.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE:
        return
    rel = duck.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(got, key=str) == sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_bare_import_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/textquarry", tmp_path / "textquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fulltext_search' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.parametrize("name", ["html_summary", "html_toc"])
def test_cut_entities_are_text(spark, tmp_path, name):
    """Headings whose last entity has lost its end (F2, F3)."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (replace(html, '</h1>', ['&amp', '&amp;&am', '&amp;&quot', '&amp;amp', '&quot;'][page_id % 5 + 1] || '</h1>') AS html) FROM read_parquet('{FOLDER}/pages.parquet')) TO '{tmp_path}/pages.parquet'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    df = QUERIES[name](spark, f"{tmp_path}")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall(), key=str)
