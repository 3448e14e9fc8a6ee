import pytest
from pyspark.sql import functions as F

from tablelens.functions import scalar as S


def _py_fmt(n):
    """The reference's number format, written out for comparison."""
    if n is None:
        return "—"
    if abs(n) >= 1e9:
        return f"{n / 1e9:.2f}B"
    if abs(n) >= 1e6:
        return f"{n / 1e6:.2f}M"
    if abs(n) >= 1e3:
        return f"{n / 1e3:.1f}K"
    if n == int(n):
        return f"{int(n):,}"
    return f"{n:,.2f}"


@pytest.mark.parametrize("v", [None, 0.0, 7.0, -3.0, 12.345, 999.99, 1234.0, 98765.4, -2500000.0, 3.21e9, 0.5])
def test_fmt_number(spark, v):
    df = spark.createDataFrame([(v,)], "v double")
    assert df.select(S.fmt_number(F.col("v")).alias("f")).collect()[0]["f"] == _py_fmt(v)


def test_percent_and_labels(spark):
    import datetime as dt
    df = spark.createDataFrame([(12.34, dt.date(2024, 3, 5))], "p double, d date")
    r = df.select(S.fmt_number(F.col("p"), True).alias("p"), S.month_name(F.col("d")).alias("m"),
                  S.month_abbr(F.col("d")).alias("a"), S.month_year(F.col("d")).alias("my")).collect()[0]
    assert (r["p"], r["m"], r["a"], r["my"]) == ("12.3%", "March", "Mar", "Mar 2024")


def test_number_tokens_and_json(spark):
    df = spark.createDataFrame([("Sales grew 12.5% to 1,200 units in 2024 (2024).",
                                 '```json\n[{"a": 1}]\n```'),
                                ("no numbers", 'text {"k": 2} tail'), ("x", "[broken")], "t string, j string")
    rows = df.select(S.number_tokens(F.col("t")).alias("n"), S.extract_json(F.col("j")).alias("j")).collect()
    assert rows[0]["n"] == ["1,200", "12.5%", "2024"] and rows[1]["n"] == []
    assert rows[0]["j"] == '[{"a": 1}]' and rows[1]["j"] == '{"k": 2}' and rows[2]["j"] is None
