import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def duck(sql, sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{sf_dir}/{f}'")
    rel = c.sql(sql)
    return [x for x in rel.columns], rel.fetchall()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


def same(df, sql, sf_dir):
    """The rows of a DataFrame are those of the SQL, columns by name."""
    names, rows = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
