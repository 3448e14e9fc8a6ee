"""Filters (F1-F5): date range, value lists, numeric range, their
conjunction and the options a filter panel offers. Every filter is a
``where`` on the lazy plan, so Catalyst pushes it into the Parquet scan
(row-group skipping on min/max statistics)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import rules as R

from tablelens.functions.columns import as_double, as_timestamp, qcol


def date_bounds(df: DataFrame, date_col: str) -> tuple[dt.date, dt.date] | None:
    """Calendar dates of the first and last timestamp (one aggregate)."""
    r = df.agg(F.min(as_timestamp(df, date_col)).alias("lo"),
               F.max(as_timestamp(df, date_col)).alias("hi")).collect()[0]
    if r["lo"] is None:
        return None
    return r["lo"].date(), r["hi"].date()


def filter_date(df: DataFrame, date_col: str, start=None, end=None, end_of_day: bool = False) -> DataFrame:
    """keep rows with start <= d <= end. Bounds are dates taken at
    midnight, so by default later rows on the end day drop out (as in the
    reference); ``end_of_day=True`` keeps the whole end day. Missing bounds
    default to the data's first and last day. Rows without a date drop."""
    if start is None or end is None:
        b = date_bounds(df, date_col)
        if b is None:
            return df.where(F.lit(False))
        start = start or b[0]
        end = end or b[1]
    def wall(x) -> F.Column:
        # literal from ISO text: a wall-clock value, independent of any zone
        if not isinstance(x, dt.datetime):
            x = dt.datetime.combine(x, dt.time())
        return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")

    start = start if isinstance(start, dt.date) else dt.date.fromisoformat(str(start))
    end = end if isinstance(end, dt.date) else dt.date.fromisoformat(str(end))
    ts = as_timestamp(df, date_col)
    if end_of_day:
        end_day = end.date() if isinstance(end, dt.datetime) else end
        return df.where((ts >= wall(start)) & (ts < wall(end_day + dt.timedelta(days=1))))
    return df.where((ts >= wall(start)) & (ts <= wall(end)))


def filter_values(df: DataFrame, selections: dict[str, list]) -> DataFrame:
    """``col IN (values)`` per column; an empty selection is no filter."""
    out = df
    for c, vals in selections.items():
        if vals:
            out = out.where(qcol(c).isin(list(vals)))
    return out


def filter_options(df: DataFrame, categorical: list[str], max_filters: int = R.MAX_FILTERS,
                   min_values: int = 2, max_values: int = R.FILTER_MAX_VALUES) -> DataFrame:
    """F2 options: (column, value) sorted distinct values of the first
    ``max_filters`` categorical columns that have 2..100 distinct values.
    One distinct-count pass picks the columns; one grouped pass lists their
    values (at most 100 per column)."""
    if not categorical:
        return df.sparkSession.createDataFrame([], "column string, value string")
    from tablelens.operators.quality import column_stats
    cnt = {r["column"]: r["nunique"] for r in column_stats(df.select(*[qcol(c) for c in categorical])).collect()}
    chosen = []
    for c in categorical:
        if len(chosen) >= max_filters:
            break
        if min_values <= cnt.get(c, 0) <= max_values:
            chosen.append(c)
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, value string")
    long_df = (df.select(*[qcol(c).cast("string").alias(c) for c in chosen])
               .unpivot([], [qcol(c) for c in chosen], "column", "value").where(F.col("value").isNotNull()))
    return long_df.select("column", "value").distinct().orderBy("column", "value")


def filter_number(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """``lo <= col <= hi``; bounds default to the column's min and max and
    the filter is skipped when they are equal. Rows missing the value drop."""
    v = as_double(df, col)
    if lo is None or hi is None:
        r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).collect()[0]
        if r["lo"] is None or not r["lo"] < r["hi"]:
            return df
        lo = r["lo"] if lo is None else lo
        hi = r["hi"] if hi is None else hi
    return df.where((v >= F.lit(float(lo))) & (v <= F.lit(float(hi))))


def filter_all(df: DataFrame, date_col: str | None = None, date_range: tuple | None = None,
               selections: dict | None = None, number_col: str | None = None,
               number_range: tuple | None = None) -> DataFrame:
    """F1 and F2 and F3 in sequence (each only if its column is given)."""
    out = df
    if date_col:
        s, e = date_range or (None, None)
        out = filter_date(out, date_col, s, e)
    if selections:
        out = filter_values(out, selections)
    if number_col:
        lo, hi = number_range or (None, None)
        out = filter_number(out, number_col, lo, hi)
    return out


def shown_of_total(filtered: DataFrame, total: DataFrame, **extra) -> DataFrame:
    """F4 status line: rows shown after filtering and rows before (plus any
    ``extra`` aggregates of the shown rows)."""
    from tablelens.functions.columns import scalars
    n = scalars(total.agg(F.count(F.lit(1)).alias("n")))["n"]
    return filtered.agg(F.count(F.lit(1)).alias("shown"), *extra.values()).select(
        "*", F.lit(n).cast("long").alias("total"))


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows with every listed column present (NaN counts as missing)."""
    from tablelens.functions.columns import present
    cond = F.lit(True)
    for c in cols:
        cond = cond & present(df, c)
    return df.where(cond)
