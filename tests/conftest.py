import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same_rows(spark_df, duck_rel):
    """Assert equal columns and equal rows, in any order."""
    names = sorted(spark_df.columns)
    assert names == sorted(duck_rel.columns)
    mine = sorted(map(repr, (tuple(r) for r in spark_df.select(*names).collect())))
    theirs = sorted(map(repr, duck_rel.select(", ".join(f'"{n}"' for n in names)).fetchall()))
    assert len(mine) == len(theirs)
    differ = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    assert not differ, differ[:3]
