import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexigrove.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(frame):
    """A frame's rows, columns by name, in an order that doesn't depend on types."""

    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)

    cols = sorted(frame.columns)
    return sorted(str([plain(v) for v in r]) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows_of(a) == rows_of(b)

    return check
