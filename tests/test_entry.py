import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quillmark.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    shown = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted((tuple(shown(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_their_sql(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["quote_id", "document_id", "position", "occurrences"]
    assert set(SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_html_spans_hold(spark):
    text = {r["document_id"]: r["text"] for r in QUERIES["html_text"](spark, FOLDER).collect()}
    for r in QUERIES["html_blocks"](spark, FOLDER).collect():
        if r["type"] not in ("list", "list_item"):
            assert text[r["document_id"]][r["span_start"] : r["span_end"]] == r["own"]


def test_the_engine_stands_without_the_optional_parts(tmp_path):
    """A copy without the training-data operators and their pipeline imports and lists its queries."""
    top = Path(__file__).resolve().parent.parent
    for name in ("quillmark", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(top / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quillmark/llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"]
