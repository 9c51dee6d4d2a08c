"""Queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestone.plans import registry

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_same_for_other_partitions(spark):
    query = registry.queries()["hybrid_search"]
    first = rows(query(spark, SF).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(query(spark, SF).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
