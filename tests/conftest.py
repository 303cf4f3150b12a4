import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def small():
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are not here")
    return folder


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    connection = duckdb.connect()
    for f in os.listdir(small):
        connection.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return connection


def same_rows(df, cursor) -> None:
    """The rows of a DataFrame and of a DuckDB result, in any order; columns by name."""
    from collections import Counter

    def norm(v):
        return round(v, 9) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v

    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    ours = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
