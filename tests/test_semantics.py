"""Direct tests of SURVEY §1.4 semantics not covered elsewhere."""

import datetime as dt

from tablelens.operators import breakdown as B
from tablelens.operators import filters as FL
from tablelens.operators import monthly as M
from tablelens.plans import profile as P
from tablelens.sources.files import preview


def test_s3_integer_year_column_is_not_a_date(spark):
    df = spark.createDataFrame([(2019 + i % 5, float(i)) for i in range(40)], "year long, amount double")
    p = P.build_profile(df)
    assert p.roles["year"] == "numeric" and p.schema["date"] == []


def test_s6_month_by_colour_not_filled_and_null_colour_dropped(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5), 1.0, "a"), (dt.datetime(2024, 3, 5), 2.0, "a"),
                                (dt.datetime(2024, 3, 6), 4.0, None)], "ts timestamp_ntz, v double, c string")
    got = sorted((r["month"], r["color"], r["value"]) for r in M.monthly_sum_by(df, "ts", "v", "c").collect())
    assert got == [(dt.date(2024, 1, 31), "a", 1.0), (dt.date(2024, 3, 31), "a", 2.0)]  # no February row


def test_s9_value_count_ties_by_value(spark):
    df = spark.createDataFrame([(x,) for x in ["z", "y", "y", "z", "b", "a"]], "k string")
    got = [(r["label"], r["count"]) for r in B.category_frequency(df, "k", 3).orderBy("rank").collect()]
    assert got == [("y", 2), ("z", 2), ("a", 1)]


def test_s13_end_bound_is_midnight_unless_asked(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 8),), (dt.datetime(2024, 1, 3),), (dt.datetime(2024, 1, 3, 17),),
                                (None,)], "ts timestamp_ntz")
    assert FL.filter_date(df, "ts").count() == 2  # 17:00 on the last day and the null drop out
    assert FL.filter_date(df, "ts", end_of_day=True).count() == 3
    assert FL.filter_date(df, "ts", dt.date(2024, 1, 2), dt.date(2024, 1, 3)).count() == 1


def test_s19_first_rows_follow_all_columns(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (None, "a"), (1, "c")], "n long, s string")
    rows = [tuple(r) for r in preview(df, 3).collect()]
    assert rows == [(None, "a"), (1, "c"), (1, "z")]
