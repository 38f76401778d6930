"""Every registered query of the engine against its SQL, at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows_of(names, cursor.fetchall())


def test_registry_needs_no_session():
    import subprocess
    import sys

    root = str(Path(__file__).resolve().parent.parent)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
