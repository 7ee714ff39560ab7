"""The driver's contract: names agree, and each query gives what its SQL gives."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strandgraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "events")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_without_the_training_data_operators(tmp_path):
    """What is left after their folders are deleted still names its queries, the pipeline not among them."""
    root = Path(entry.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "strandgraph", tmp_path / "strandgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120)
    queries, sql = (set(line.split()) for line in said.stdout.splitlines()[-2:])
    assert queries == set(registry.queries()) and sql == set(registry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "level"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    got, expected = registry.queries()[name](spark, SF), db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda x: sorted(x, key=repr)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(expected.fetchall())
