import datetime as dt

import pytest

from tablelens.functions import names as N
from tablelens.operators import ingest as I
from tablelens.plans import profile as P


def test_name_tokens_whole_words():
    # FIXTURES names: country/valid must not match count/id; salesAmount
    # matches sales and amount; user_id is an id name but not a customer role;
    # 'Net Income' matches no profit keyword (net_income can never be a token).
    assert not N.matches("country", ["count"]) and not N.matches("valid", ["id"])
    assert N.tokens("salesAmount") == {"sales", "amount"}
    assert N.matches("user_id", N.ID_HINTS) and not N.matches("user_id", N.SEMANTIC_ROLE_HINTS["customer"])
    assert not N.matches("Net Income", N.SEMANTIC_ROLE_HINTS["profit"])
    assert N.tokens("Sales_Amount USD") == {"sales", "amount", "usd"}


def test_tokens_expr_matches_python(spark):
    from pyspark.sql import functions as F
    names = ["salesAmount", "Net Income", "order_ID2x", "ABCdef"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: set(r["t"]) for r in df.select("n", N.tokens_expr(F.col("n")).alias("t")).collect()}
    assert got == {n: N.tokens(n) for n in names}


def test_money_text_coercion(spark):
    # FIXTURES money_text
    df = spark.createDataFrame([("$1,200", "1"), (" 45% ", "2"), ("€7", "5d"), ("-$5", "3"), ("", "4"),
                                (None, None)], "amount string, other string")
    assert I.numeric_text_columns(df) == ["amount"]
    out, conv = I.coerce_money(df)
    assert conv == ["amount"]
    assert [r["amount"] for r in out.collect()] == [1200.0, 45.0, 7.0, -5.0, None, None]


def test_date_text_detection(spark):
    rows = [((dt.date(2024, 1, 1) + dt.timedelta(days=i)).isoformat(),) for i in range(60)] + [("not a date",)]
    df = spark.createDataFrame(rows, "created_at string")
    assert I.detect_date_format(df.limit(50), "created_at") == "yyyy-MM-dd"
    bad = spark.createDataFrame([("2024-01-01",), ("01/02/2024",)], "order_date string")
    assert I.detect_date_format(bad, "order_date") is None
    coerced = I.coerce_dates(df, {"created_at": "yyyy-MM-dd"}).collect()
    assert coerced[0]["created_at"] == dt.datetime(2024, 1, 1) and coerced[-1]["created_at"] is None


def test_roles_and_profile(spark):
    rows = [(i, f"cust{i % 40}", ["N", "S", "E", "W"][i % 4], float(i % 17) * 1.5, f"${i * 3}",
             dt.datetime(2024, 1 + i % 12, 1), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "order_id long, customer string, region string, sales double, "
                                     "list_price string, created timestamp_ntz, flag long")
    p = P.build_profile(df)
    assert p.roles == {"order_id": "id", "customer": "categorical", "region": "categorical",
                       "sales": "numeric", "list_price": "numeric", "created": "date", "flag": "boolean"}
    assert p.primary_measure == "sales" and p.dataset_type == "Time Series"
    assert p.semantic_roles["revenue"] == ["sales"] and p.semantic_roles["customer"] == ["customer"]
    assert p.semantic_roles["order"] == ["order_id"]
    prepared = P.prepare(df, p)
    assert dict(prepared.dtypes)["list_price"] == "double"


def test_primary_by_largest_sum_and_template(spark):
    df = spark.createDataFrame([(1.0, 100.0, 5.0), (2.0, 300.0, 7.0)] * 5, "a double, b double, cost double")
    assert P.pick_primary_measure(df, ["a", "b"]) == ("b", "largest_sum")
    assert P.pick_primary_measure(df, ["a", "b", "cost"]) == ("cost", "keyword")
    assert P.pick_primary_measure(df, ["a", "b", "cost"], "Finance")[0] == "cost"


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a long, b string")
    p = P.build_profile(empty)
    assert p.rows == 0 and p.roles == {"a": None, "b": None} and p.dataset_type == "Unstructured"
    nulls = spark.createDataFrame([(1, None), (2, None)], "a long, b string")
    assert P.build_profile(nulls).roles["b"] is None


def test_date_layouts_of_all_columns_by_one_mask(spark):
    df = spark.createDataFrame([("2024-01-31", "31/01/2024", "Jan 5, 2024", "x", None), ("2024-02-29", "01/02/2024", None, "2024-01-01", None)],
                               "a string, b string, c string, d string, e string")
    assert I.detect_date_formats(df, df.columns) == {"a": "yyyy-MM-dd", "b": "dd/MM/yyyy", "c": "MMM d, yyyy"}
    assert I.detect_date_formats(df, []) == {} and I.detect_date_formats(df.limit(0), ["a"]) == {}
    # a value that two layouts fit keeps both until another decides
    both = spark.createDataFrame([("01/02/2024",), ("13/02/2024",)], "a string")
    assert I.detect_date_format(both, "a") == "dd/MM/yyyy" and I.detect_date_format(both.limit(1), "a") in ("MM/dd/yyyy", "dd/MM/yyyy")
