import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from phonolith.session import SETTINGS

    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.fixture
def same(spark, duck):
    """Runs a query in both engines and compares rows, in any order."""

    def norm(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, 6) + 0.0
        return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v

    def check(query, sql):
        df = query(spark, DATA)
        got = df.collect()
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([norm(r[names.index(c)]) for c in df.columns]) for r in cur.fetchall())
        assert sorted(repr([norm(v) for v in r]) for r in got) == want

    return check
