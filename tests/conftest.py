import os
import sys
from pathlib import Path

import duckdb
import pytest

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, os.environ.get("PYTHONPATH", "")])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from subsidia.session import build_session

    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def matches(spark, duck):
    """Asserts that a query has the rows of its SQL, in any order."""

    def plain(value):
        if isinstance(value, float):
            return None if value != value else value + 0.0
        return value

    def check(function, sql):
        frame = function(spark, SF)
        names = sorted(frame.columns)
        ours = [tuple(plain(row[n]) for n in names) for row in frame.collect()]
        result = duck.execute(sql)
        theirs_names = [d[0] for d in result.description]
        assert sorted(theirs_names) == names
        theirs = [tuple(plain(row[theirs_names.index(n)]) for n in names) for row in result.fetchall()]
        order = lambda row: tuple((v is None, str(v)) for v in row)
        assert sorted(ours, key=order) == sorted(theirs, key=order)
        assert ours

    return check
