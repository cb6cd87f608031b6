import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query with its SQL on DuckDB, order-insensitively."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def norm(v):
        return round(v, 6) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, DATA)
        cols = sorted(df.columns)
        q = con.sql(sql)
        assert sorted(q.columns) == cols
        at = [q.columns.index(c) for c in cols]
        want = sorted(repr([norm(r[i]) for i in at]) for r in q.fetchall())
        got = sorted(repr([norm(v) for v in r]) for r in df.select(*cols).collect())
        assert got == want

    return check
