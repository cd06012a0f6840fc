import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def smoke_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def oracle(small_dir):
    """Rows of a SQL query over the small tables."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(small_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    """A value as compared: doubles to six decimals, containers as tuples."""
    if isinstance(value, float):
        return round(value, 6) + 0.0 if value == value else None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same_rows(spark, small_dir, oracle):
    """Assert that a query and its SQL give the same rows."""

    def check(query, sql):
        frame = query(spark, small_dir)
        columns = sorted(frame.columns)
        got = sorted((tuple(normal(r[c]) for c in columns) for r in frame.collect()), key=repr)
        found = oracle.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
        assert got == want

    return check
