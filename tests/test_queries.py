"""Each query with SQL gives the rows that DuckDB gives; each other one runs."""

import math

import duckdb
import pandas as pd
import pytest

from bandloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return str(v) if isinstance(v, pd.Timestamp) else v

    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, db, name):
    made, expected = catalogue.QUERIES[name](spark, data).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(expected.columns)
    assert rows(made, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    made = __spark_entry__.entry(spark)
    assert made.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_crop_reaches_the_scan(spark, tmp_path):
    from bandloom.operators import selection

    spark.range(100).selectExpr("'a' AS frame_id", "cast(id AS int) AS y", "cast(id AS int) AS x", "array(1D) AS dn").write.parquet(str(tmp_path / "px"))
    plan = selection.crop_top_left(spark.read.parquet(str(tmp_path / "px")), 3, 4).select("x")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(y,3)" in plan and "dn" not in plan
