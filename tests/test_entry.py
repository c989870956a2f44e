"""All queries of the tables against their SQL, and the entry points without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from siftline.plans import catalog

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in DATA.iterdir():
        files = f if f.is_file() else f / "*.parquet"
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def plain(pdf, columns):
    whole = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    values = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return sorted(str(tuple(map(whole, row))) for row in values.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, tables):
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    if name not in catalog.oracle_sql():
        assert name == "q_mask_lines"
        return
    want = tables.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["siftline/llm", "tests/llm"], ["siftline/llm", "tests/llm", "corpus_pipeline.py"]])
def test_works_without_the_optional_parts(tmp_path, gone):
    for part in REPO.iterdir():
        if part.name not in (".git", ".pytest_cache"):
            subprocess.run(["cp", "-r", part, tmp_path / part.name], check=True)
    for part in gone:
        if (tmp_path / part).exists():
            subprocess.run(["rm", "-r", tmp_path / part], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_reconcile' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
