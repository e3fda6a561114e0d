import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a Spark result has the rows, names and types of a SQL result."""

    def check(df, sql):
        a, b = df.toPandas(), duck.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns)
        rows = lambda x: sorted(map(repr, x[cols].itertuples(index=False, name=None)))
        assert rows(a) == rows(b)
        assert {c: str(a[c].dtype) for c in cols} == {c: str(b[c].dtype) for c in cols}

    return check
