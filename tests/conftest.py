import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(shared / "warehouse")).config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 8)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compare a query with its SQL twin: column names and all rows."""

    def check(query, sql):
        df, rel = query(spark, DATA), duck.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns)
        key = lambda r: tuple((x is None, str(x)) for x in r)
        got = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=key)
        want = sorted((tuple(map(_plain, r)) for r in rel.select(*columns).fetchall()), key=key)
        assert got == want

    return check
