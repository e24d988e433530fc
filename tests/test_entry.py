"""Every screening query against its SQL on the small tables, and the driver's functions."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from epilattice.plans import queries as screening

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(screening.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = screening.QUERIES[name](spark, DIR)
    found = duck.execute(screening.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(names).collect()) == want


def test_without_the_optional_operators(tmp_path):
    """The entry without the operators' folders, with and without the pipeline's file."""
    root = Path(e.__file__).parent
    shutil.copytree(root, tmp_path / "a", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    shutil.copytree(tmp_path / "a", tmp_path / "b", ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    # an emptied folder, and operators whose module is missing
    shutil.copytree(tmp_path / "a", tmp_path / "c")
    (tmp_path / "c/epilattice/llm").mkdir()
    shutil.copytree(root, tmp_path / "d", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "d/zstandard.py").write_text("raise ImportError")
    for folder in "abcd":
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout
        assert out.split() == [str(len(screening.QUERIES)), str(len(screening.ORACLES)), "False"]


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(screening.QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(set(screening.QUERIES) - set(screening.ORACLES)))
def test_others_run(spark, name):
    """What SQL can't say, on tables that have enough mutations; tests/test_scores.py says whether it is right."""
    assert screening.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
