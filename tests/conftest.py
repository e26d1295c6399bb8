import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(path):
    """DuckDB's name for a table that is a file or a folder of files."""
    return f"'{path}/*.parquet'" if os.path.isdir(path) else f"'{path}'"


def same(spark_df, sql, folder):
    """Do a Spark result and a DuckDB query agree, rows in any order and columns by name?"""
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            c.execute(f"create view {name[:-8]} as select * from {table(f'{folder}/{name}')}")
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(spark_df.columns)
    plain = lambda x: tuple(round(v, 6) if isinstance(v, float) else v for v in x)
    got = sorted((plain(r) for r in spark_df.select(*names).collect()), key=repr)
    assert got == sorted((plain(r) for r in want.fetchall()), key=repr)
    return got
