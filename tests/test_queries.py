"""Every registered query of the library against the same statement in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from marginalia.jobs import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = sql.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_survives_without_text_operators(tmp_path):
    """A copy of the repository without the folders of the text operators and the pipeline still has all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[2]
    shutil.copytree(root / "marginalia", tmp_path / "marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'op1_token_files' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE_SQL)), "False"], done.stderr
