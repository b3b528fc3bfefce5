"""The registered queries against their SQL."""

import hashlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tabsieve.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    r = db.sql(SQL[name])
    order = [r.columns.index(c) for c in df.columns]
    key = lambda row: tuple(map(str, row))
    assert sorted(rows, key=key) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=key)


def test_csv_roundtrip_of_many_lines(spark, tmp_path):
    texts = ["a;b\n" * 101, 'say ""x"";\r\n"' * 500, "\n" * 3000, "plain"]
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text_md5"] for r in QUERIES["csv_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_entry_needs_no_llm(tmp_path):
    """A copy of the repository without the subpackage lists the other queries; a broken subpackage raises."""
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    root = os.path.dirname(os.path.abspath(e.__file__))
    shutil.copytree(f"{root}/tabsieve", tmp_path / "tabsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    names = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert names == sorted(QUERIES)
    (tmp_path / "tabsieve" / "llm").mkdir()
    for name in ("tabsieve/llm/__init__.py", "corpus_pipeline.py"):
        (tmp_path / name).write_text("")
    (tmp_path / "tabsieve/llm/queries.py").write_text("import nothing_of_this_name\n")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert broken.returncode and "nothing_of_this_name" in broken.stderr
