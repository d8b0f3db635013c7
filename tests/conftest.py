"""One session for all tests, with this repository on its workers' path."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ["PYSPARK_PYTHON"] = sys.executable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from metrascope.session import build_session

    session = build_session("local[4]", 4, "4g", **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    db = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Compares a query with its SQL, rows in any order and doubles to 6 places."""

    def compare(query, sql):
        df = query(spark, sf)
        told = duck.execute(sql)
        names = [c[0] for c in told.description]
        assert sorted(names) == sorted(df.columns)
        order, plain = sorted(names), lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
        ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in told.fetchall())
        assert ours == theirs
        return ours

    return compare
