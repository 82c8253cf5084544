import os

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.scheduler.mode", "FAIR")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with a DuckDB relation as multisets of rows with equal names."""

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        ours = sorted(tuple(normal(r[n]) for n in names) for r in df.collect())
        at = [relation.columns.index(n) for n in names]
        theirs = sorted(tuple(normal(r[i]) for i in at) for r in relation.fetchall())
        assert ours == theirs

    return check
