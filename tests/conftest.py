"""One local session for all tests."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tests-')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = Path(small) / f"{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Does a frame hold the rows of an SQL query, whatever their order?"""
    import pandas as pd

    def text(x):
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 9))
        return str(x)

    def rows(pdf):
        cols = sorted(pdf.columns)
        return cols, sorted(tuple("" if (x is None or x is pd.NA or x != x) else text(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None))

    return lambda df, sql: rows(df.toPandas()) == rows(duck.sql(sql).df())
