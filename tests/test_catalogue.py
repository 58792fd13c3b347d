import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in got.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*names).collect()) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fan_out_scans_once_and_pushes_the_filter(spark):
    text = plan_of(catalogue.capture_lineitem_fanout(spark, SF))
    assert text.count("FileScan") == 1 and "Or(" in text and "Exchange" not in text


def test_replay_pushes_the_time_bounds_and_top1_is_bounded(spark):
    assert "GreaterThanOrEqual(ts" in plan_of(catalogue.replay_range(spark, SF))
    assert "TakeOrderedAndProject" in plan_of(catalogue.first_after_lsn(spark, SF))
