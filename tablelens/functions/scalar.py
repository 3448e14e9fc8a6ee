"""Scalar Column functions (C1-C7): number formatting, calendar labels,
number tokens and JSON extraction from text. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number-token pattern of the fact-preservation check.
NUMBER_TOKEN = r"\d[\d,.]*%?"


def fmt_number(c: Column, is_percent: bool = False) -> Column:
    """Human-friendly number: '—' when missing, '12.5%' for percents,
    B / M with 2 decimals, K with 1 decimal, whole numbers without decimals,
    else 2 decimals. Values are rounded (half up) before formatting, so the
    text is the same on every engine that rounds the same way."""
    x = c.cast("double")
    missing = x.isNull() | F.isnan(x)
    if is_percent:
        return F.when(missing, "—").otherwise(F.format_string("%.1f%%", F.round(x, 1)))
    ax = F.abs(x)
    return (F.when(missing, F.lit("—"))
            .when(ax >= 1e9, F.format_string("%.2fB", F.round(x / 1e9, 2)))
            .when(ax >= 1e6, F.format_string("%.2fM", F.round(x / 1e6, 2)))
            .when(ax >= 1e3, F.format_string("%.1fK", F.round(x / 1e3, 1)))
            .when(x == F.floor(x), x.cast("long").cast("string"))
            .otherwise(F.format_string("%.2f", F.round(x, 2))))


def year(c: Column) -> Column:
    return F.year(c)


def month_name(c: Column) -> Column:
    """C3: 'January'."""
    return F.date_format(c, "MMMM")


def month_abbr(c: Column) -> Column:
    """C3: 'Jan'."""
    return F.date_format(c, "MMM")


def month_year(c: Column, long: bool = False) -> Column:
    """C4: 'Jan 2024' (or 'January 2024')."""
    return F.date_format(c, "MMMM yyyy" if long else "MMM yyyy")


def iso_date(c: Column) -> Column:
    """C4: 'yyyy-MM-dd'."""
    return F.date_format(c, "yyyy-MM-dd")


def number_tokens(c: Column) -> Column:
    """Sorted distinct number-like tokens ('1,200', '45%', '3.5')."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), 0)))


def strip_fences(c: Column) -> Column:
    """Remove markdown code fences (```json ... ```) around a payload."""
    return F.regexp_replace(F.trim(c), r"(?m)^```(?:json)?\s*|\s*```$", "")


def extract_json(c: Column) -> Column:
    """The JSON payload in a text: the whole (fence-stripped) text if it
    parses, else the widest [...] span, else the widest {...} span; null if
    none of these parses."""
    t = strip_fences(c)
    arr = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    obj = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    ok = lambda x: F.try_parse_json(x).isNotNull()
    return (F.when(ok(t), t)
            .when((arr != "") & ok(arr), arr)
            .when((arr == "") & (obj != "") & ok(obj), obj))
