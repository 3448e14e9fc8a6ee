import datetime as dt

import pandas as pd
import pytest

from tablelens.operators import quality as Q


def test_duplicates_treat_nulls_as_equal(spark):
    rows = [("a", None), ("a", None), ("a", None), ("b", 1.0), ("b", 1.0), ("c", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    assert Q.duplicate_count(df).collect()[0]["dup_rows"] == int(pdf.duplicated().sum()) == 3
    listed = Q.duplicate_rows(df, 50).collect()
    assert len(listed) == int(pdf.duplicated(keep=False).sum()) == 5
    assert Q.duplicate_rows(df, 2).count() == 2


def test_missing_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y")], "a double, b string")
    got = {r["column"]: (r["missing"], r["pct"]) for r in Q.missing_by_column(df).collect()}
    assert got == {"a": (2, 66.67), "b": (1, 33.33)}


def test_health_score_formula(spark):
    rows = [(i, f"n{i % 3}", float(i)) for i in range(40)] + [(0, "n0", 0.0)] * 2
    df = spark.createDataFrame(rows, "id long, name string, v double")
    pdf = pd.DataFrame(rows, columns=["id", "name", "v"])
    h = Q.health(df).collect()[0]
    dup = pdf.duplicated().sum()
    dup_pct = dup / (len(pdf) + 1e-9)
    expected = int(max(0, min(100, 40 + max(0, 30 * (1 - dup_pct * 3)) + 10 + 15 * len(pdf) / 500)))
    assert h["dup_rows"] == dup == 2 and h["score"] == expected
    assert 0 <= h["score"] <= 100 and h["grade"] in "ABCDF"


def test_distinct_counts_exact_and_approx(spark):
    df = spark.createDataFrame([(i % 4, float(i % 3), None if i % 5 == 0 else f"s{i % 6}", -0.0 if i == 1 else 0.0)
                                for i in range(30)], "a long, b double, c string, z double")
    got = {r["column"]: (r["n"], r["nunique"]) for r in Q.distinct_counts(df).collect()}
    assert got == {"a": (30, 4), "b": (30, 3), "c": (24, 6), "z": (30, 1)}
    approx = {r["column"]: r["nunique"] for r in Q.distinct_counts(df, approx=True).collect()}
    assert approx["a"] == 4


def test_export_summary_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x long, y string")
    rows = {r["metric"]: r["value"] for r in Q.export_summary(Q.health(df)).collect()}
    assert rows["Rows"] == 3 and rows["Columns"] == 2 and rows["Duplicate Rows"] == 1 and rows["Missing Cells"] == 1


def test_duplicates_with_any_join(spark):
    # the join of the repeated hashes is AQE's choice: same rows with and without broadcast
    rows = [(i % 7, None if i % 5 == 0 else float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "a long, b double")
    expected = int(pd.DataFrame(rows, columns=["a", "b"]).duplicated().sum())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert Q.duplicate_count(df).collect()[0]["dup_rows"] == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stage_modes(spark):
    from tablelens.session import stage
    df = spark.range(1000).selectExpr("id", "id % 10 as k")
    for mode in ("persist", "checkpoint", "table", None):
        s = stage(df, mode)
        assert s.count() == 1000 and s.columns == ["id", "k"]
        if mode == "persist":
            s.unpersist()
    assert spark.conf.get("spark.checkpoint.dir")


def test_caches_are_released(spark):
    from tablelens.operators import breakdown as B
    from tablelens.plans.report import collect_all, dashboard, quality_page
    cached = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = cached().size()
    df = spark.createDataFrame([(f"g{i % 5}", float(i % 17), i) for i in range(200)], "g string, v double, id long")
    d = dashboard(df, persist="persist")
    collect_all({**d.frames(), **quality_page(d)})
    B.underserved(df, "g", "v").collect()
    d.release()
    assert cached().size() == before


def test_distinct_counts_by_bitmap(spark):
    # dense, sparse 64-bit, negative, date, timestamp, boolean, null and hot integer columns
    import random
    rnd = random.Random(5)
    edge = [-2 ** 63, 2 ** 63 - 1, -1, 0, 63, 64, -64, -65]
    rows = [(i // 3, edge[i] if i < len(edge) else rnd.randrange(-2 ** 63, 2 ** 63), -(i % 500), None, i % 2 == 0, 7 if i % 3 else i,
             dt.date(1969, 12, 1) + dt.timedelta(days=i % 90), dt.datetime(1960, 1, 1) + dt.timedelta(seconds=i // 2)) for i in range(3000)]
    names = ["dense", "sparse", "neg", "none", "flag", "hot", "day", "at"]
    df = spark.createDataFrame(rows, "dense long, sparse long, neg int, none long, flag boolean, hot short, day date, at timestamp_ntz")
    got = {r["column"]: r for r in Q.column_stats(df).collect()}
    for i, c in enumerate(names):
        vals = [r[i] for r in rows if r[i] is not None]
        assert (got[c]["rows"], got[c]["n"], got[c]["nunique"]) == (3000, len(vals), len(set(vals))), c
        if c in ("dense", "sparse", "neg", "hot"):
            assert (got[c]["lo"], got[c]["hi"]) == (float(min(vals)), float(max(vals))), c
    assert got["none"]["lo"] is None and (got["flag"]["lo"], got["flag"]["hi"]) == (0.0, 1.0)
    assert got["day"]["lo"] == -31.0 and got["at"]["lo"] == (dt.datetime(1960, 1, 1) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)
