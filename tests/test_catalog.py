"""Every catalogue query against its SQL, on the smallest driver tables."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else str(round(float(v), 6))

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_pins_never_broadcast_the_registry(spark):
    plan = catalog.QUERIES["pin_override"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "name#" in line]


def test_walks_are_not_cut_at_a_number_of_nodes(spark, tmp_path):
    spark.range(50_100).select(F.col("id").alias("p_partkey"), F.lit(50).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["walk_as_of"](spark, str(tmp_path)).groupBy("completeness").count().collect()
    assert [tuple(r) for r in got] == [("resolved", 50_100)]
