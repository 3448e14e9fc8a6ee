import pytest

from tablelens.operators import breakdown as B


@pytest.fixture
def ties(spark):
    # FIXTURES ties: top 3 is a, b, c; max a; min e (an all-missing group sums to 0)
    return spark.createDataFrame([("d", 1.0), ("c", 1.0), ("b", 1.0), ("a", 2.0), ("e", None), (None, 5.0)],
                                 "k string, v double")


def test_top_n_breaks_ties_by_key(ties):
    got = [(r["label"], r["value"], r["rank"]) for r in B.bar_top(ties, "k", "v", 3).orderBy("rank").collect()]
    assert got == [("a", 2.0, 1), ("b", 1.0, 2), ("c", 1.0, 3)]


def test_null_key_dropped_and_missing_sum_is_zero(ties):
    g = {r["label"]: r["value"] for r in B.group_sum(ties, "k", "v").collect()}
    assert None not in g and g["e"] == 0.0 and len(g) == 5


def test_best_worst(ties):
    rows = {r["kind"]: r["label"] for r in B.best_worst(ties, "k", "v").collect()}
    assert rows == {"best": "a", "second": "b", "worst": "e"}


def test_shares_and_pareto(ties):
    s = B.share(ties, "k", "v", 10).collect()
    assert sum(r["pct"] for r in s) == pytest.approx(100.0)
    p = B.pareto(ties, "k", "v", 15).orderBy("rank").collect()
    assert p[-1]["cumulative_pct"] == pytest.approx(100.0)
    cnt = B.share(ties, "k", None, 10).collect()
    assert sum(r["value"] for r in cnt) == 5


def test_concentration(ties):
    r = B.concentration(ties, "k", "v").collect()[0]
    assert r["n_groups"] == 5 and r["top_label"] == "a"
    assert r["top_share_pct"] == pytest.approx(40.0) and r["top3_share_pct"] == pytest.approx(80.0)
    assert r["concentrated"] is False


def test_top_record_and_topk(ties):
    r = B.top_record(ties, "k", "v").collect()[0]
    assert (r["label"], r["value"]) == (None, 5.0)  # the null-key row holds the max
    rows = B.top_k_members(ties, "k", 2).collect()
    assert sorted(r["k"] for r in rows) == ["a", "b"]


def test_underserved(spark):
    rows = [("big", 1.0)] * 10 + [("mid", 2.0)] * 6 + [("small", 9.0)] * 3 + [("tiny", 1.0)] * 3
    df = spark.createDataFrame(rows, "k string, v double")
    r = B.underserved(df, "k", "v").collect()
    # counts 10, 6, 3, 3 -> median 4.5; means 1, 2, 9, 1 -> median 1.5
    assert [(x["label"], x["n"]) for x in r] == [("small", 3)]


@pytest.mark.parametrize("shape", ["skewed", "flat", "negative", "few", "infinite"])
def test_top_of_many_labels(spark, shape):
    """Bucket bounds never change the rows, and skewed columns keep few of them."""
    label = {"few": "id % 3"}.get(shape, "case when id % 3 > 0 then id % 11 else id end")
    label = "id" if shape == "flat" else label
    value = {"negative": "-1.5 - id % 7", "infinite": "if(id = 5, double('inf'), 1)"}.get(shape, "if(id % 5 = 0, -2, id % 13)")
    df = spark.range(30_000).selectExpr(f"if(id % 101 = 0, null, {label}) as k", f"cast(if(id % 17 = 0, null, {value}) as double) as v")
    for y in ("v", None):
        run = (lambda many: B.bar_top(df, "k", y, 7, many)) if y else (lambda many: B.category_frequency(df, "k", 7, many))  # noqa: B023
        assert sorted(map(tuple, run(True).collect())) == sorted(map(tuple, run(False).collect()))
    if shape == "skewed":
        assert B._of_many(df, "k", None, 7).select("k").distinct().count() < 200
    assert B.category_frequency(df.limit(0), "k", 7, True).count() == 0


def test_members_of_many_labels(spark):
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, id % 5 * 2, id) as k", "id as _b")
    got = B.top_k_members(df, "k", 3, many=True)
    assert got.columns == ["k", "_b"] and sorted(got.collect()) == sorted(B.top_k_members(df, "k", 3).collect())
