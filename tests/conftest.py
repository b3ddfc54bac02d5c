from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


def _plain(v: object) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(df: DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())


def sql_rows(sql: str, sf_dir: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    assert sorted(got.columns) == sorted(columns)
    order = [got.columns.index(c) for c in sorted(got.columns)]
    return sorted(tuple(_plain(r[i]) for i in order) for r in got.fetchall())


@pytest.fixture(scope="session")
def same_as_sql(sf_dir):
    def check(df: DataFrame, sql: str) -> None:
        assert rows_of(df) == sql_rows(sql, sf_dir, df.columns)

    return check
