"""One small session for all tests, and the driver's smallest tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables aren't here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df, columns=None):
    cols = sorted(columns or df.columns)
    return sorted(repr(tuple(round(v, 7) if isinstance(v := r[c], float) else v for c in cols)) for r in df.collect())


def sql_rows(duck, sql):
    x = duck.execute(sql)
    names = [d[0] for d in x.description]
    cols = sorted(names)
    return cols, sorted(repr(tuple(round(v, 7) if isinstance(v := r[names.index(c)], float) else v for c in cols)) for r in x.fetchall())
