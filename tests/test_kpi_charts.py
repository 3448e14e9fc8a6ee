import datetime as dt

import pandas as pd
import pytest

from tablelens.plans import charts as C
from tablelens.plans import kpi as K
from tablelens.plans import profile as P


@pytest.fixture
def staff(spark):
    rows = [(f"E{i:03d}", ["ops", "hr", "it", "fin", "law"][i % 5], 1000.0 + (i * 37) % 500,
             dt.date(2023, 1 + (i % 12), 1 + i % 27)) for i in range(120)]
    return spark.createDataFrame(rows, "employee_id string, dept string, salary double, hire_date date"), rows


def test_kpi_ladder_without_revenue(staff):
    df, rows = staff
    prof = P.build_profile(df)
    assert prof.roles == {"employee_id": "id", "dept": "categorical", "salary": "numeric", "hire_date": "date"}
    cards = K.build_kpis(df, prof).orderBy("ord").collect()
    labels = [c["label"] for c in cards]
    assert labels == ["Total Records", "Total salary", "Total Orders", "Growth %", "Unique dept", "Date Range"]
    pdf = pd.DataFrame(rows, columns=["employee_id", "dept", "salary", "hire_date"])
    by = {c["label"]: c for c in cards}
    assert by["Total salary"]["value"] == pytest.approx(pdf.salary.sum())
    assert by["Total salary"]["sub_value"] == pytest.approx(pdf.salary.mean())
    assert by["Total Orders"]["value"] == 120 and by["Total Orders"]["sub_text"] == "unique records"
    monthly = pdf.assign(d=pd.to_datetime(pdf.hire_date)).set_index("d").resample("ME")["salary"].sum()
    pct = round(float((monthly.iloc[-1] - monthly.iloc[-2]) / abs(monthly.iloc[-2]) * 100), 1)
    assert by["Growth %"]["value"] == pct == by["Total salary"]["trend_pct"]
    assert by["Unique dept"]["value"] == 5
    assert by["Date Range"]["value"] == (pdf.hire_date.max() - pdf.hire_date.min()).days
    assert by["Date Range"]["sub_text"] == "Jan 2023 – Dec 2023"
    # the same ladder with counts taken from the profile
    again = K.build_kpis(df, prof, profile_counts=True).orderBy("ord").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in cards]


def test_kpi_ladder_text_only(spark):
    df = spark.createDataFrame([(["a", "b", "c"][i % 3], ["x", "y"][i % 2]) for i in range(30)], "c1 string, c2 string")
    prof = P.build_profile(df)
    cards = K.build_kpis(df, prof).orderBy("ord").collect()
    assert [(c["label"], c["value"]) for c in cards] == [("Total Records", 30.0), ("Unique c1", 3.0),
                                                         ("Unique c2", 2.0)]
    specs = C.rule_based_specs(df, prof)
    assert [(s["type"], s["x"], s["y"]) for s in specs] == [("pie", "c2", None), ("bar", "c2", None)]
    data = C.auto_charts(df, prof).collect()
    assert {(r["chart"], r["label"]) for r in data} == {(1, "x"), (1, "y"), (2, "x"), (2, "y")}


def test_chart_specs_and_dispatch(staff):
    df, _ = staff
    prof = P.build_profile(df)
    specs = C.rule_based_specs(df, prof)
    assert [s["type"] for s in specs] == ["line", "bar", "histogram", "pie", "bar", "rolling_avg", "pareto"]
    bad = [{"type": "bogus", "x": "dept"}, {"type": "bar", "x": "nope"}, {"type": "line"}, "x"]
    assert C.validate_specs(df, bad) == []
    assert C.run_spec(df, {"type": "bar", "x": "dept"}, prof).count() == 5  # frequency when y is missing
    assert C.run_spec(df, {"type": "heatmap", "x": "hire_date", "y": "salary"}, prof).count() == 1
    assert C.run_spec(df, {"type": "box", "x": "dept", "y": "salary"}, prof).count() == 5
    assert C.run_spec(df, {"type": "line", "x": "hire_date", "y": "salary", "color": "nope"}, prof).count() == 12


def test_kpis_with_awkward_column_names(spark):
    df = spark.createDataFrame([(float(i), float(i % 4), f"g{i % 3}") for i in range(20)],
                               "`Net.Sales` double, `unit cost` double, `grp.name` string")
    prof = P.build_profile(df)
    cards = {c["label"]: c["value"] for c in K.build_kpis(df, prof).collect()}
    assert cards["Total Revenue"] == sum(range(20)) and cards["Avg unit cost"] == pytest.approx(1.5)


def test_dashboard_with_awkward_column_names(spark):
    from tablelens.plans.report import collect_all, dashboard
    rows = [(float(i % 50), f"r{i % 4}", f"c`{i % 3}", dt.date(2023, 1 + i % 12, 1), i) for i in range(120)]
    df = spark.createDataFrame(rows, "`sales.usd` double, `the region` string, `odd``name` string, "
                                     "`order date` date, `row.id` long")
    d = dashboard(df, persist=None)
    res = collect_all(d.frames())
    assert d.profile.primary_measure == "sales.usd" and d.profile.schema["date"] == ["order date"]
    assert res["kpis"][1]["label"] == "Total Revenue" and res["kpis"][1]["value"] == sum(r[0] for r in rows)
    assert len(res["charts"]) > 0 and len(res["insights"]) > 0


def test_every_chart_type_dispatches(staff):
    df, _ = staff
    prof = P.build_profile(df)
    specs = {"line": ("hire_date", "salary"), "bar": ("dept", "salary"), "barh": ("dept", "salary"),
             "pie": ("dept", "salary"), "scatter": ("salary", "salary"), "histogram": (None, "salary"),
             "box": ("dept", "salary"), "heatmap": ("hire_date", "salary"), "treemap": ("dept", "salary"),
             "funnel": ("dept", "salary"), "violin": ("dept", "salary"), "cumulative": ("hire_date", "salary"),
             "rolling_avg": ("hire_date", "salary"), "pareto": ("dept", "salary")}
    assert set(specs) == set(C.SUPPORTED)
    for t, (x, y) in specs.items():
        data = C.run_spec(df, {"type": t, "x": x, "y": y}, prof)
        assert data is not None and data.count() > 0, t
    charts = C.auto_charts(df, prof, [{"type": t, "x": x, "y": y} for t, (x, y) in specs.items()]).collect()
    assert {r["type"] for r in charts} == set(specs)


def test_quality_page(staff):
    from tablelens.plans.report import collect_all, dashboard, quality_page
    df, rows = staff
    d = dashboard(df, with_insights=False)
    res = collect_all(quality_page(d))
    assert res["duplicate_count"][0]["dup_rows"] == 0 and res["duplicate_rows"] == []
    assert {r["column"] for r in res["uniqueness"]} == {"employee_id", "dept", "salary", "hire_date"}
    assert [r["column"] for r in res["outliers"]] == ["salary"]
    assert {r["metric"] for r in res["summary"]} == {"Rows", "Columns", "Missing Cells", "Duplicate Rows",
                                                     "Health Score"}
    assert len(res["preview"]) == 10 and res["missing"] == []
    d.release()


def test_dashboard_approx_mode(staff):
    from tablelens.plans.report import collect_all, dashboard
    df, _ = staff
    d = dashboard(df, approx=True)
    res = collect_all(d.frames())
    assert d.profile.roles["dept"] == "categorical" and res["kpis"][0]["value"] == 120
    assert any(r["section"] == "outliers" for r in res["insights"])
    d.release()


def test_trends_of_all_measures_from_one_scan(spark):
    import datetime as dt

    from tablelens.operators.monthly import mom_trend_kpi, mom_trends_kpi
    day = dt.date
    rows = [(day(2024, 1, 5), 1.0, 5.0, None, 2.0), (day(2024, 1, 20), 3.0, None, None, 0.0), (day(2024, 3, 31), 6.0, 7.0, 4.0, None),
            (day(2024, 4, 1), -2.0, None, None, None), (None, 9.0, 9.0, 9.0, 9.0), (day(2024, 2, 29), None, None, None, -2.0)]
    df = spark.createDataFrame(rows, "d date, a double, b double, c double, z double")
    measures = ["a", "b", "c", "z"]
    got = {measures[r["i"]]: (r["trend_pct"], r["trend_up"]) for r in mom_trends_kpi(df, "d", measures).collect()}
    for c in measures:  # each as from its own dense series: a gap month counts 0
        one = mom_trend_kpi(df, "d", c).collect()
        assert got[c] == (one[0]["trend_pct"], one[0]["trend_up"]), c
    assert got["a"] == (-133.3, False) and got["b"] == (None, None) and got["z"] == (-200.0, False)
    plan = mom_trends_kpi(df, "d", measures)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Union" not in plan
