import datetime
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value that compares equal whichever engine it came from."""
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def same_rows(spark_frame, duck, sql):
    relation = duck.execute(sql)
    names = [x[0] for x in relation.description]
    assert sorted(spark_frame.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in spark_frame.collect()), key=repr)
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in relation.fetchall()), key=repr)
    assert ours == theirs
    return len(ours)
