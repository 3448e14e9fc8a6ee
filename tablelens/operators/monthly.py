"""Monthly series over a date column and a measure.

Month bins follow calendar months labelled by their last day (DateType), and
the dense series carries months with no rows as 0 between the first and the
last month that has data. The scan is aggregated once to one row per month
(partial aggregation on the map side, a tiny shuffle); everything after that
works on at most a few thousand month rows, so windows without a partition
key and broadcast joins here are bounded by the calendar span, not by data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import rules as R

from tablelens.functions.columns import as_date, as_double, qcol

MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _pairs(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """(d, v) with both present: the reference drops a row if either is missing."""
    return (df.select(as_date(df, date_col).alias("d"), as_double(df, measure).alias("v"))
            .where(F.col("d").isNotNull() & F.col("v").isNotNull()))


def month_sums(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """Sparse monthly sums: (month, value, rows) for months that have rows."""
    return (_pairs(df, date_col, measure)
            .groupBy(F.last_day("d").alias("month"))
            .agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("rows")))


def monthly_sum(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """Dense monthly sum (month date, value double); gap months are 0.
    Each month with rows also fills the gap up to the next one, so the table
    is read once and nothing is joined."""
    first = F.trunc("month", "MM")
    last = F.coalesce(F.add_months(F.trunc(F.lead("month").over(_ordered()), "MM"), -1), first)
    filled = month_sums(df, date_col, measure).select(
        F.col("month").alias("own"), "value",
        F.sequence(first, last, F.expr("INTERVAL 1 MONTH")).alias("months"))
    return (filled.select("own", "value", F.explode("months").alias("m")).withColumn("month", F.last_day("m"))
            .select("month", F.when(F.col("month") == F.col("own"), F.col("value")).otherwise(0.0).alias("value")))


def monthly_sum_by(df: DataFrame, date_col: str, measure: str, color: str) -> DataFrame:
    """Month x colour sums, no gap filling, null colours dropped."""
    return (df.select(as_date(df, date_col).alias("d"), as_double(df, measure).alias("v"),
                      qcol(color).cast("string").alias("color"))
            .where(F.col("d").isNotNull() & F.col("v").isNotNull() & F.col("color").isNotNull())
            .groupBy(F.last_day("d").alias("month"), "color")
            .agg(F.sum("v").alias("value")))


def _ordered():
    return Window.orderBy("month")


def cumulative_monthly(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """Running total of the dense monthly series."""
    w = _ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = monthly_sum(df, date_col, measure)
    return m.select("month", "value", F.sum("value").over(w).alias("cumulative"))


def rolling_monthly(df: DataFrame, date_col: str, measure: str, window: int = R.ROLLING_MONTHS) -> DataFrame:
    """Trailing mean over ``window`` months (a shorter window at the start)."""
    w = _ordered().rowsBetween(-(window - 1), Window.currentRow)
    m = monthly_sum(df, date_col, measure)
    return m.select("month", "value", F.avg("value").over(w).alias("rolling"))


def _last_two(monthly: DataFrame) -> DataFrame:
    """Last month with its predecessor and the series length, one row."""
    w = _ordered()
    return (monthly
            .select("month", "value",
                    F.lag("value").over(w).alias("previous"),
                    F.count(F.lit(1)).over(Window.partitionBy()).alias("n_months"))
            .orderBy(F.col("month").desc()).limit(1))


def mom_trend_kpi(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """Strict month-over-month change of the last two months, percent to
    1 dp; null when fewer than two months or |previous| < 1e-9."""
    t = _last_two(monthly_sum(df, date_col, measure))
    raw = (F.col("value") - F.col("previous")) / F.abs(F.col("previous")) * 100
    ok = F.col("previous").isNotNull() & (F.abs(F.col("previous")) >= 1e-9)
    return t.select(
        "month", F.col("value").alias("current"), "previous",
        F.when(ok, F.round(raw, 1)).alias("trend_pct"),
        F.when(ok, raw >= 0).alias("trend_up"))


def mom_trends_kpi(df: DataFrame, date_col: str, measures: Sequence[str]) -> DataFrame:
    """W5 for several measures from one scan: (i, trend_pct, trend_up), i the
    measure's place. All measures are columns of one sum by month; what follows
    has one row per month and measure."""
    sums = [f for i, c in enumerate(measures) for f in (F.sum(as_double(df, c)).alias(f"v{i}"), F.count(as_double(df, c)).alias(f"n{i}"))]
    months = df.groupBy(F.last_day(as_date(df, date_col)).alias("month")).agg(*sums).where("month is not null")
    each = ", ".join(f"named_struct('i', {i}, 'value', v{i}, 'n', n{i})" for i in range(len(measures)))
    w = Window.partitionBy("i").orderBy("month")
    t = (months.selectExpr("month", f"inline(array({each}))").where("n > 0")
         .select("i", "month", "value", F.lag("month").over(w).alias("before"), F.lag("value").over(w).alias("own"),
                 F.lead("month").over(w).alias("after")).where("after is null"))
    # a gap month before the last one counts 0; a first month has none before
    adjacent = F.col("before") == F.last_day(F.add_months(F.trunc("month", "MM"), -1))
    previous = F.when(adjacent, F.col("own")).when(F.col("before").isNotNull(), F.lit(0.0))
    t = t.withColumn("previous", previous)
    raw = (F.col("value") - F.col("previous")) / F.abs(F.col("previous")) * 100
    ok = F.col("previous").isNotNull() & (F.abs(F.col("previous")) >= 1e-9)
    return t.select("i", F.when(ok, F.round(raw, 1)).alias("trend_pct"), F.when(ok, raw >= 0).alias("trend_up"))


def mom_trend_insight(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """The insight/chat form, (cur-prev)/(|prev|+1e-9)*100; needs 2 months."""
    return mom_trend_of(monthly_sum(df, date_col, measure))


def mom_trend_of(m: DataFrame) -> DataFrame:
    """W6 over a ready dense series."""
    t = _last_two(m).where(F.col("previous").isNotNull())
    pct = (F.col("value") - F.col("previous")) / (F.abs(F.col("previous")) + 1e-9) * 100
    return t.select("month", F.col("value").alias("current"), "previous",
                    pct.alias("pct"),
                    F.when(pct >= 0, "grew").otherwise("fell").alias("direction"))


def best_worst_month(df: DataFrame, date_col: str, measure: str, min_months: int = R.BEST_MONTH_MIN_MONTHS) -> DataFrame:
    """Highest and lowest month of the dense series (earliest on ties)."""
    return best_worst_month_of(monthly_sum(df, date_col, measure), min_months)


def best_worst_month_of(m: DataFrame, min_months: int = R.BEST_MONTH_MIN_MONTHS) -> DataFrame:
    """W7 over a ready dense series."""
    agg = m.agg(F.count(F.lit(1)).alias("n"),
                F.min(F.struct(F.negative("value").alias("nv"), "month")).alias("hi"),
                F.min(F.struct("value", "month")).alias("lo"))
    agg = agg.where(F.col("n") >= min_months)
    best = agg.select(F.lit("best").alias("kind"), F.col("hi.month").alias("month"),
                      F.negative(F.col("hi.nv")).alias("value"))
    worst = agg.select(F.lit("worst").alias("kind"), F.col("lo.month").alias("month"),
                       F.col("lo.value").alias("value"))
    return best.unionByName(worst)


def trajectory(df: DataFrame, date_col: str, measure: str, min_months: int = R.TRAJECTORY_MIN_MONTHS) -> DataFrame:
    """Least-squares slope of the dense series against 0..n-1."""
    return trajectory_of(monthly_sum(df, date_col, measure), min_months)


def trajectory_of(m: DataFrame, min_months: int = R.TRAJECTORY_MIN_MONTHS) -> DataFrame:
    """W8 over a ready dense series."""
    idx = m.select("value", (F.row_number().over(_ordered()) - 1).cast("double").alias("i"))
    return (idx.agg(F.count(F.lit(1)).alias("n_months"), F.regr_slope("value", "i").alias("slope"))
            .where(F.col("n_months") >= min_months)
            .select("n_months", "slope",
                    F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction")))


def date_range(df: DataFrame, date_col: str) -> DataFrame:
    """First and last timestamp, whole days between them, month labels."""
    from tablelens.functions.columns import as_timestamp
    ts = as_timestamp(df, date_col)
    a = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    return a.where(F.col("first").isNotNull()).select(
        "first", "last",
        F.expr("timestampdiff(DAY, first, last)").cast("long").alias("days"),
        F.date_format("first", "MMM yyyy").alias("first_month"),
        F.date_format("last", "MMM yyyy").alias("last_month"))


def month_heatmap(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """Year x month-of-year sums; month columns Jan..Dec that occur in the
    data, in calendar order; a missing cell is null."""
    p = _pairs(df, date_col, measure)
    piv = (p.select(F.year("d").alias("year"), F.month("d").alias("mon"), "v")
           .groupBy("year").pivot("mon", list(range(1, 13))).agg(F.sum("v")))
    piv = piv.select("year", *[F.col(str(i)).alias(MONTH_ABBR[i - 1]) for i in range(1, 13)])
    # Which months occur: one tiny aggregate over the (years x 12) result.
    seen = piv.agg(*[F.count(qcol(m)).alias(m) for m in MONTH_ABBR]).collect()[0]
    keep = [m for m in MONTH_ABBR if seen[m] > 0]
    return piv.select("year", *keep)


def seasonal_low(df: DataFrame, date_col: str, measure: str, min_names: int = R.SEASONAL_MIN_NAMES) -> DataFrame:
    """Calendar month name with the lowest mean (alphabetical on ties),
    only when at least ``min_names`` month names occur."""
    p = _pairs(df, date_col, measure)
    by = p.groupBy(F.date_format("d", "MMMM").alias("month_name")).agg(F.avg("v").alias("avg_value"))
    agg = by.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("avg_value", "month_name")).alias("lo"))
    return (agg.where(F.col("n") >= min_names)
            .select(F.col("lo.month_name").alias("month_name"), F.col("lo.avg_value").alias("avg_value")))
