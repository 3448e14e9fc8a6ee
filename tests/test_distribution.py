import math

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import distribution as D
from tablelens.operators.quantiles import exact_quantiles


def _values(spark, vals, name="v"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in vals], f"{name} double")


@pytest.mark.parametrize("buckets", [1 << 14, 8])
def test_exact_quantiles_match_numpy(spark, buckets):
    # 8 buckets: no task gets more than 9 rows a band, over many rounds
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.round(rng.normal(0, 10, 2000), 2), np.zeros(1000)])  # a hot value
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "k", "v", probs, buckets=buckets)
    for key in ("a", "b"):
        sub = np.array([v for i, v in enumerate(vals) if ("a" if i % 3 else "b") == key])
        assert got[key]["n"] == len(sub)
        for p in probs:
            assert got[key][p] == pytest.approx(np.quantile(sub, p), abs=1e-9)


def test_histogram_counts_all_values(spark):
    df = _values(spark, [1, 2, 2, 3, 10, None, float("nan")])
    h = D.histogram(df, "v", 30).orderBy("bin").collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 5
    assert h[-1]["count"] == 1 and h[-1]["hi"] == 10.0  # the max lands in the last bin
    const = D.histogram(_values(spark, [4, 4, 4]), "v").collect()
    assert [(r["bin"], r["count"]) for r in const] == [(1, 3)]


def test_outliers_match_pandas(spark):
    rng = np.random.default_rng(3)
    a = np.round(np.concatenate([rng.normal(50, 5, 300), [500, -300]]), 2)
    b = np.round(rng.uniform(0, 1, 302), 2)
    pdf = pd.DataFrame({"a": a, "b": b, "c": [1.0, 2.0, 3.0, 4.0] + [None] * 298})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in D.outliers(df, ["a", "b", "c"]).collect()}
    assert "c" not in got  # fewer than 5 values
    for col in ("a", "b"):
        s = pdf[col].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        iqr = q3 - q1
        n_iqr = int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())
        z = (s - s.mean()) / (s.std() + 1e-9)
        assert got[col]["iqr_outliers"] == n_iqr
        assert got[col]["zscore_outliers"] == int((z.abs() > 3).sum())
        assert got[col]["std"] == round(float(s.std()), 2)
        assert got[col]["pct_of_rows"] == round(n_iqr / len(s) * 100, 2)


def test_correlation_pairwise_complete_and_constant(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, None, 6.0], "y": [2.0, 4.1, 6.3, 7.9, 10.0, None],
                        "k": [5.0] * 6})
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in D.corr_pairs(df, ["x", "y", "k"]).collect()}
    assert got[("x", "y")] == pytest.approx(pdf["x"].corr(pdf["y"]))
    assert got[("x", "k")] is None or math.isnan(got[("x", "k")])  # constant: no error under ANSI
    top = D.corr_top(df, ["x", "y", "k"]).collect()
    assert [(r["col_a"], r["col_b"]) for r in top] == [("x", "y")]
    s = D.strongest_corr(df, "y", ["x", "y", "k"]).collect()[0]
    assert s["column"] == "x"


def test_box_by_category(spark):
    rows = [("a", float(v)) for v in range(1, 21)] + [("a", 100.0)] + [("b", float(v)) for v in range(5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["label"]: r for r in D.box_by_category(df, "k", "v", 8).collect()}
    s = pd.Series([float(v) for v in range(1, 21)] + [100.0])
    assert got["a"]["median"] == s.median() and got["a"]["q1"] == s.quantile(0.25)
    assert got["a"]["outliers"] == 1 and got["a"]["whisker_high"] == 20.0


def test_scatter_sample_is_repeatable_and_bounded(spark):
    df = spark.range(5000).selectExpr("id", "id * 2.0 as x", "id % 7 as y", "cast(id % 20 as string) as c")
    a = D.scatter_sample(df, "x", "y", "id", "c", n=100).collect()
    b = D.scatter_sample(df, "x", "y", "id", "c", n=100).collect()
    assert len(a) == 100 and sorted(r["key"] for r in a) == sorted(r["key"] for r in b)
    assert all(r["color"] is None for r in a)  # 20 colours > 12


def test_sketch_quantiles_are_close(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(0, 1, 5000)
    df = spark.createDataFrame([("k", float(v)) for v in vals], "k string, v double")
    got = exact_quantiles(df, "k", "v", [0.25, 0.5, 0.75], exact=False)["k"]
    for p in (0.25, 0.5, 0.75):
        assert abs(got[p] - np.quantile(vals, p)) < 0.01
    o = D.outliers(spark.createDataFrame([(float(v),) for v in vals], "v double"), ["v"], exact=False).collect()
    assert o[0]["iqr_outliers"] >= 0


def test_histogram_with_known_bounds(spark):
    from tablelens.plans import profile as P
    df = _values(spark, [1.5, 2, 2, 3, 10, None, -4])
    prof = P.build_profile(df)
    assert prof.bounds["v"] == (-4.0, 10.0)
    a = [tuple(r) for r in D.histogram(df, "v").orderBy("bin").collect()]
    b = [tuple(r) for r in D.histogram(df, "v", bounds=prof.bounds["v"]).orderBy("bin").collect()]
    assert a == b


def test_exact_quantiles_mixed_small_and_large_keys(spark):
    rng = np.random.default_rng(11)
    big = np.round(rng.exponential(5, 3000), 2)
    small = np.round(rng.normal(0, 1, 20), 3)
    rows = [("big", float(v)) for v in big] + [("small", float(v)) for v in small]
    df = spark.createDataFrame(rows, "k string, v double")
    got = exact_quantiles(df, "k", "v", [0.1, 0.5, 0.9], buckets=16)
    for key, vals in (("big", big), ("small", small)):
        for p in (0.1, 0.5, 0.9):
            assert got[key][p] == pytest.approx(np.quantile(vals, p), abs=1e-9)


def test_exact_quantiles_of_extreme_values(spark):
    vals = [-math.inf, -1.7e308, -1.0, 0.0, 5e-324, 1e-323, 1.5e-323, 2e-323, 1.0, 1.0 + 2 ** -52, 1e18, 1.7e308,
            math.inf]
    df = spark.createDataFrame([("k", v) for v in vals] + [("one", 3.0), ("none", None)], "k string, v double")
    probs = [i / (len(vals) - 1) for i in range(len(vals))]
    got = exact_quantiles(df, "k", "v", probs, buckets=16)
    assert [got["k"][p] for p in probs] == vals
    assert got["one"][0.5] == 3.0 and "none" not in got


def test_band_shuffle_is_bounded_by_the_buckets(spark, monkeypatch):
    # 40,000 distinct values, quartiles far apart: a running sum never sees more than a band's buckets
    from tablelens.operators import quantiles as Qn
    seen = []
    df = spark.range(40000).selectExpr("'k' as k", "cast(id * id as double) as v")
    settle = Qn._settle
    monkeypatch.setattr(Qn, "_settle", lambda f, o, t, band: (seen.append(band[3]), settle(f, o, t, band)))
    got = exact_quantiles(df, "k", "v", [0.25, 0.5, 0.75], buckets=64)["k"]
    for p in (0.25, 0.5, 0.75):
        assert got[p] == pytest.approx(np.quantile(np.arange(40000.0) ** 2, p))
    assert max(seen[6:]) < 40000 / 4  # each rank follows a band of its own, not one from 0.25 to 0.75


def test_sample_without_key_is_uniform(spark, monkeypatch):
    # 20 stores, a tenth without one, only few distinct rows: every store gets its share of the sample
    df = spark.range(40000).selectExpr("if(id % 10 = 0, null, id % 20) as store", "cast(id % 4 as double) as y")
    monkeypatch.setattr(D, "COPIES_PER_ROW", 300)
    rows = [tuple(r) for r in D.scatter_sample(df, "store", "y", n=2000).collect()]
    assert len(rows) == 2000 and rows == [tuple(r) for r in D.scatter_sample(df, "store", "y", n=2000).collect()]
    share = pd.Series([r[0] for r in rows]).value_counts(dropna=False)
    assert len(share) == 19 and share.drop(np.nan).between(60, 150).all() and 140 < share[np.nan] < 270


def test_correlations_merge_over_tasks_and_large_offsets(spark):
    # values near 1e9 with a small spread, holes, a column constant where another is present, an empty one
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, 4000)
    pdf = pd.DataFrame({"a": 1e9 + base, "b": -3e9 + 0.5 * base + rng.normal(0, 1, 4000), "c": rng.normal(0, 1e-3, 4000) + np.arange(4000) * 1e6,
                        "part": np.where(np.arange(4000) < 1000, 7.1, base), "none": np.full(4000, np.nan), "k": np.full(4000, 0.1)})
    pdf.loc[::3, "b"] = np.nan
    pdf["few"] = np.where(np.arange(4000) < 1000, base, np.nan)
    df = spark.createDataFrame(pdf).repartition(13)
    want = pdf.corr()
    got = {(r["col_a"], r["col_b"]): r["r"] for r in D.corr_pairs(df, list(pdf)).collect()}
    assert len(got) == 21
    for (x, y), r in got.items():
        if {x, y} & {"none", "k"} or {x, y} == {"part", "few"}:
            assert r is None, (x, y)
        else:
            assert r == pytest.approx(want.loc[x, y], abs=1e-6), (x, y)
    assert D.strongest_corr(df, "a", list(pdf)).collect()[0]["column"] == "few"
    empty = D.corr_pairs(df.limit(0), ["a", "b"]).collect()
    assert [(r["col_a"], r["col_b"], r["r"]) for r in empty] == [("a", "b", None)]


def test_wide_correlations_are_one_scan_without_expand(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    wide = li.selectExpr(*[f"l_extendedprice * {i % 7} + l_quantity * {i} + l_tax as w{i}" for i in range(200)])
    pairs = D.corr_pairs(wide, wide.columns)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan and "Generate" not in plan
    assert pairs.where("r is not null").count() == 200 * 199 // 2


def test_quantiles_survive_a_sketch_that_misses(spark, monkeypatch):
    # brackets of no width seldom hold the rank: later rounds find it
    from tablelens.operators import quantiles as Qn
    monkeypatch.setattr(Qn, "SKETCH_SIZE", 8)
    vals = np.random.default_rng(2).normal(0, 100, 30000)
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": vals}))
    for reach in (1e-4, 0.02):
        monkeypatch.setattr(Qn, "RANK_ERROR", reach)
        got = exact_quantiles(df, "k", "v", [0.01, 0.25, 0.5, 0.51, 0.75])["x"]
        assert got["n"] == 30000 and all(got[p] == pytest.approx(np.quantile(vals, p), abs=1e-9) for p in (0.01, 0.25, 0.5, 0.51, 0.75))


def test_violin_density_is_near_the_kernel_density_of_the_rows(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(10, 2, 800), "b": rng.gamma(2.0, 3.0, 500)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("flat", 1.0)] * 5 + [(None, 2.0), ("a", None)]
    got = D.violin_density(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    assert {r["label"] for r in got} == {"a", "b"}
    for k, vs in values.items():
        h = 1.059 * vs.std(ddof=1) * len(vs) ** -0.2
        curve = sorted((r["x"], r["density"]) for r in got if r["label"] == k)
        assert len(curve) == 100 and abs(curve[0][0] - (vs.min() - 2 * h)) < 1e-9 and abs(curve[-1][0] - (vs.max() + 2 * h)) < 1e-9
        exact = [np.exp(-0.5 * ((x - vs) / h) ** 2).sum() / (len(vs) * h * np.sqrt(2 * np.pi)) for x, _ in curve]
        assert np.abs(np.array(exact) - [y for _, y in curve]).max() < 0.01 * max(exact)


def test_scatter_sample_by_place_needs_no_shuffle_and_is_fair(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).selectExpr("id % 4 as x", "cast(id as double) as y").repartition(5).write.parquet(path)
    df = spark.read.parquet(path).where("y >= 0")
    s = D.scatter_sample(df, "x", "y", n=2000, file="_metadata.file_path")
    assert "Exchange hash" not in s._jdf.queryExecution().executedPlan().toString()
    ys = [r["y"] for r in s.collect()]
    assert len(set(ys)) == 2000 and ys == [r["y"] for r in s.collect()]
    assert abs(np.mean(ys) - 10_000) < 4 * 20_000 / np.sqrt(12 * 2000)
