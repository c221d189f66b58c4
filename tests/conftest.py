import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    """A value as both engines give it: floats to nine digits, times without zone."""
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return float(v) if hasattr(v, "as_tuple") else v


def same_rows(df, con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    theirs = r.fetchall()
    assert sorted(names) == sorted(df.columns)
    mine = df.collect()
    a = sorted((tuple(plain(x[c]) for c in sorted(names)) for x in mine), key=repr)
    b = sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in sorted(names)) for x in theirs), key=repr)
    assert a == b
