"""Properties from SURVEY §5.4 on random small frames, and the tiny-table
guards of FIXTURES (one row, zero rows, an all-null column)."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.operators import breakdown as B
from tablelens.operators import distribution as D
from tablelens.operators import filters as FL
from tablelens.operators import monthly as M
from tablelens.operators import quality as Q

rows_st = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d", None]),
                             st.one_of(st.none(), st.integers(-500, 500).map(lambda x: x / 4)),
                             st.integers(0, 700)), min_size=1, max_size=40)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    return spark.createDataFrame([(k, v, dt.datetime(2023, 1, 1) + dt.timedelta(days=d)) for k, v, d in rows],
                                 "k string, v double, ts timestamp_ntz")


@SETTINGS
@given(rows=rows_st)
def test_breakdown_properties(spark, rows):
    df = _df(spark, rows)
    total = sum(v for k, v, _ in rows if k is not None and v is not None)
    bars = B.bar_top(df, "k", "v", 15).collect()
    assert sum(r["value"] for r in bars) == pytest.approx(total)  # <= 15 groups: nothing cut
    p = B.pareto(df, "k", "v", 15).orderBy("rank").collect()
    if p and sum(r["value"] for r in p) != 0:
        assert p[-1]["cumulative_pct"] == pytest.approx(100.0)


@SETTINGS
@given(rows=rows_st)
def test_distribution_and_monthly_properties(spark, rows):
    df = _df(spark, rows)
    present = [v for _, v, _ in rows if v is not None]
    h = D.histogram(df, "v", 30).collect()
    assert sum(r["count"] for r in h) == len(present)
    cum = M.cumulative_monthly(df, "ts", "v").orderBy("month").collect()
    if present:
        assert cum[-1]["cumulative"] == pytest.approx(sum(present))
    health = Q.health(df).collect()[0]
    assert 0 <= health["score"] <= 100
    f = FL.filter_number(df, "v", -10, 10)
    assert f.subtract(df).count() == 0  # filtered rows are input rows


def test_gap_months_on_orders_of_one_customer(spark):
    # FIXTURES gap_orders: one customer's orders leave most months empty
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").where(F.col("o_custkey") == 11)
    pdf = o.select("o_orderdate", "o_totalprice").toPandas()
    exp = pdf.set_index("o_orderdate").resample("ME")["o_totalprice"].sum()
    got = M.monthly_sum(o, "o_orderdate", "o_totalprice").orderBy("month").toPandas()
    assert len(got) == len(exp) and (got["value"] == 0).sum() == (exp == 0).sum()
    assert got["value"].to_numpy() == pytest.approx(exp.to_numpy())
    roll = M.rolling_monthly(o, "o_orderdate", "o_totalprice").orderBy("month").toPandas()["rolling"]
    assert roll.to_numpy() == pytest.approx(exp.rolling(3, min_periods=1).mean().to_numpy())


def test_tiny_tables_do_not_break_the_report(spark):
    from tablelens.plans.report import EmptyTableError, collect_all, dashboard
    one = spark.createDataFrame([(1, "a", 2.5, dt.datetime(2024, 1, 1), None)],
                                "id long, cat string, amount double, ts timestamp_ntz, empty string")
    d = dashboard(one, persist=None)
    assert d.profile.roles["empty"] is None and d.profile.rows == 1
    res = collect_all(d.frames())
    assert res["kpis"][0]["label"] == "Total Records" and res["kpis"][0]["value"] == 1
    assert any(r["title"] == "Keep Monitoring" or r["section"] == "health" for r in res["insights"])
    with pytest.raises(EmptyTableError):
        dashboard(one.limit(0), persist=None)
