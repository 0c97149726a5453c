import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scorelake.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def as_rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in at) for r in rows)


@pytest.fixture
def tiny_chunks(monkeypatch):
    """Cuts every key into chunks of about three rows."""
    from scorelake.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 3)
