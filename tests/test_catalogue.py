"""Every query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lorekeep.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_scan_is_pruned(spark):
    """Predicates on promoted fields and scope reach the scan; only what is used is read."""
    from lorekeep.operators import query as Q
    from lorekeep.operators.filters import CreatedAfter, Gt
    from lorekeep.plans import adapters as A

    q = Q.matching(A.events(spark, SF), Q.Query("events", filter=Gt("value", 100) & CreatedAfter(0)), A.EVENT_FIELDS).select("record_id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "event_type" not in plan.split("ReadSchema")[1]
