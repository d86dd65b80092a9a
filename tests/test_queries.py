"""Every query that has SQL gives the rows of that SQL; the others run and give rows."""

import duckdb
import pytest

from lodeseek.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    names = want.columns
    assert got == sorted("|".join(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in want.fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_points_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert said.stdout.strip().endswith("True"), said.stderr
