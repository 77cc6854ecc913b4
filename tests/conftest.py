"""A local session, and DuckDB over the same tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
from settings import SF, TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compare two row sets without their order; numbers to six digits."""

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6) + 0.0
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)

    def check(df, con, sql):
        names = sorted(df.columns)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == names
        order = [columns.index(n) for n in names]
        want = sorted(repr([plain(r[k]) for k in order]) for r in result.fetchall())
        got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
        assert got == want

    return check
