import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import monthly as M


def _frame(spark, rows, schema="ts timestamp_ntz, v double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def month_edge(spark):
    # FIXTURES month_edge: a 15:00 stamp on the last day stays in its month,
    # gap months are 0.
    return _frame(spark, [(dt.datetime(2024, 1, 31, 15), 1.0), (dt.datetime(2024, 2, 1), 2.0),
                          (dt.datetime(2024, 2, 3), 4.0), (dt.datetime(2024, 5, 31, 23, 59, 59), 3.0)])


def test_dense_month_spine(month_edge):
    got = [(r["month"], r["value"]) for r in M.monthly_sum(month_edge, "ts", "v").orderBy("month").collect()]
    assert got == [(dt.date(2024, 1, 31), 1.0), (dt.date(2024, 2, 29), 6.0), (dt.date(2024, 3, 31), 0.0),
                   (dt.date(2024, 4, 30), 0.0), (dt.date(2024, 5, 31), 3.0)]


def test_matches_pandas_resample(spark):
    rng = np.random.default_rng(7)
    ts = pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 900, 300), unit="D") \
        + pd.to_timedelta(rng.integers(0, 86400, 300), unit="s")
    v = np.round(rng.normal(100, 30, 300), 2)
    pdf = pd.DataFrame({"ts": ts, "v": v})
    pdf.loc[::17, "v"] = np.nan
    exp = pdf.dropna().set_index("ts").resample("ME")["v"].sum()
    df = spark.createDataFrame([(t.to_pydatetime(), None if np.isnan(x) else float(x))
                                for t, x in zip(pdf.ts, pdf.v)], "ts timestamp_ntz, v double")
    got = M.monthly_sum(df, "ts", "v").orderBy("month").toPandas()
    assert len(got) == len(exp)
    assert np.allclose(got["value"].to_numpy(), exp.to_numpy())
    roll = M.rolling_monthly(df, "ts", "v", 3).orderBy("month").toPandas()["rolling"].to_numpy()
    assert np.allclose(roll, exp.rolling(3, min_periods=1).mean().to_numpy())
    cum = M.cumulative_monthly(df, "ts", "v").orderBy("month").toPandas()["cumulative"].to_numpy()
    assert np.allclose(cum, exp.cumsum().to_numpy())
    traj = M.trajectory(df, "ts", "v").collect()[0]
    slope = np.polyfit(np.arange(len(exp)), exp.to_numpy(), 1)[0]
    assert traj["slope"] == pytest.approx(slope)


def test_trend_needs_two_months_and_nonzero_previous(spark, month_edge):
    one = _frame(spark, [(dt.datetime(2024, 1, 2), 5.0), (dt.datetime(2024, 1, 9), 1.0)])
    r = M.mom_trend_kpi(one, "ts", "v").collect()[0]
    assert r["trend_pct"] is None and r["trend_up"] is None
    assert M.mom_trend_insight(one, "ts", "v").count() == 0
    # previous month is the zero-filled April: strict form gives null, the
    # epsilon form gives a huge percentage.
    r = M.mom_trend_kpi(month_edge, "ts", "v").collect()[0]
    assert r["previous"] == 0.0 and r["trend_pct"] is None
    r = M.mom_trend_insight(month_edge, "ts", "v").collect()[0]
    assert r["direction"] == "grew" and r["pct"] > 1e9


def test_best_worst_month_ties_take_earliest(month_edge):
    rows = {r["kind"]: (r["month"], r["value"]) for r in M.best_worst_month(month_edge, "ts", "v").collect()}
    assert rows["best"] == (dt.date(2024, 2, 29), 6.0)
    assert rows["worst"] == (dt.date(2024, 3, 31), 0.0)  # March and April are 0: March first


def test_heatmap_keeps_only_present_months(month_edge):
    h = M.month_heatmap(month_edge, "ts", "v")
    assert h.columns == ["year", "Jan", "Feb", "May"]
    r = h.collect()[0]
    assert (r["Jan"], r["Feb"], r["May"]) == (1.0, 6.0, 3.0)


def test_seasonal_low_needs_four_names(spark, month_edge):
    assert M.seasonal_low(month_edge, "ts", "v").count() == 0  # Jan, Feb, May only
    df = _frame(spark, [(dt.datetime(2024, m, 1), 2.0) for m in (1, 2, 3, 4)] + [(dt.datetime(2023, 3, 1), 0.0)])
    r = M.seasonal_low(df, "ts", "v").collect()[0]
    assert r["month_name"] == "March" and r["avg_value"] == 1.0


def test_date_range_whole_days(month_edge):
    r = M.date_range(month_edge, "ts").collect()[0]
    assert r["days"] == 121 and r["first_month"] == "Jan 2024" and r["last_month"] == "May 2024"
