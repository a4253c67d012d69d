import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from touchline.session import local_session

    s = local_session(8, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in sorted(Path(DATA).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{at}'")
    return c


def same_rows(df, cursor):
    """Compare a DataFrame with a DuckDB result by column name, regardless of order."""
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    key = lambda r: tuple((x is None, x != x, "" if x is None or x != x else x) for x in r)
    norm = lambda x: None if isinstance(x, float) and x != x else x
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(norm(r[i]) for i in at) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(b))), (g, w)
