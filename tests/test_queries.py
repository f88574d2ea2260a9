"""Every query with SQL gives the rows of its SQL in DuckDB; the package imports without the optional parts."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from wayquad.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return c


def normal(df):
    cols = sorted(df.columns)
    for k in cols:
        if df[k].dtype.kind == "f":
            df[k] = df[k].map(lambda v: repr(float(v) + 0.0))
    return cols, sorted(map(tuple, df[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert normal(QUERIES[name](spark, SF_DIR).toPandas()) == normal(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_without_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "wayquad"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "wayquad").mkdir()
    for p in (ROOT / "wayquad").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "wayquad" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2:3].isdigit() or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
