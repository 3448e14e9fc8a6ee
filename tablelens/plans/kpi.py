"""KPI set (K1, A22): a fixed ladder of at most 8 cards whose names follow the
detected business roles.

The ladder is decided on the driver from column names and roles; every
number comes from one fused aggregate (sums, means, maxima, date bounds),
one distinct-count pass for the columns that need it, and one
job for the month-over-month trends of all measures (W5). The cards are rows of one Spark frame
``(ord, label, value, sub_value, sub_text, trend_pct, trend_up)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import rules as R
from tablelens.functions.columns import as_double, as_timestamp, is_numeric, qcol
from tablelens.operators.monthly import mom_trends_kpi
from tablelens.plans.profile import Profile


def _distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Exact distinct counts of ``cols``: one grouped pass over the
    unpivoted columns (no per-column Expand of the whole table)."""
    if not cols:
        return {}
    from tablelens.operators.quality import column_stats
    sub = df.select(*[qcol(c) for c in cols])
    return {r["column"]: int(r["nunique"]) for r in column_stats(sub).select("column", "nunique").collect()}


class Facts:
    """The figures behind the cards: aggregates of one fused pass and distinct
    counts, each registered once and referred to by name."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggregates: dict[str, F.Column] = {"rows": F.count(F.lit(1))}
        self.distinct: list[str] = []

    def _add(self, kind: str, c: str, aggregate) -> F.Column:
        # named by column position: column names may hold dots or spaces
        name = f"{kind}_{self.df.columns.index(c)}"
        self.aggregates[name] = aggregate
        return F.col(name)

    def rows(self) -> F.Column:
        return F.col("rows")

    def total(self, c: str) -> F.Column:
        return self._add("sum", c, F.coalesce(F.sum(as_double(self.df, c)), F.lit(0.0)))

    def mean(self, c: str) -> F.Column:
        return self._add("avg", c, F.avg(as_double(self.df, c)))

    def largest(self, c: str) -> F.Column:
        return self._add("max", c, F.max(as_double(self.df, c)))

    def values(self, c: str) -> F.Column:
        self.distinct += [] if c in self.distinct else [c]
        return F.col(f"d_{self.distinct.index(c)}")

    def span(self, c: str) -> tuple[F.Column, F.Column]:
        t = as_timestamp(self.df, c)
        return self._add("lo", c, F.min(t)), self._add("hi", c, F.max(t))


@dataclass(frozen=True)
class Duties:
    """Which column serves which business duty; a column serves one at most."""
    revenue: str | None
    main: str | None
    profit: str | None
    order: str | None
    record: str | None
    customer: str | None

    def serving(self) -> set:
        return {self.main, self.profit, self.order or self.record, self.customer}


def duties(df: DataFrame, profile: Profile) -> Duties:
    roles, taken = profile.semantic_roles, set()

    def claim(candidates, summed: bool = False) -> str | None:
        for c in candidates:
            if c not in taken and not (summed and not is_numeric(df, c) and c not in profile.numeric_text):
                taken.add(c)
                return c
        return None

    revenue = claim(roles.get("revenue", []), summed=True)
    main = revenue or claim(filter(None, [profile.primary_measure]))
    profit = claim(roles.get("profit", []), summed=True)
    order = claim(roles.get("order", []))
    record = None if order else next(iter(profile.schema["id"]), None)
    taken.add(record)
    return Duties(revenue, main, profit, order, record, claim(roles.get("customer", [])))


def _trends(df: DataFrame, date_col: str | None, measures: list[str]) -> dict[str, tuple]:
    """{measure: (percent, up)} of the last month against the one before (W5):
    one scan for all measures."""
    if not date_col or not measures:
        return {}
    return {measures[r["i"]]: (r["trend_pct"], r["trend_up"]) for r in mom_trends_kpi(df, date_col, measures).collect()}


# ---------------------------------------------------------------------------
# The catalogue's cards, in their order. A card is shown when its
# column ``c`` exists: (label, column's duty, sub text, value, sub value), the
# last two as functions of (facts, c, duties).
LADDER = [
    ("Total Records", "any", "rows in dataset", lambda f, c, d: f.rows(), None),
    ("Total Revenue", "revenue", None, lambda f, c, d: f.total(c), lambda f, c, d: f.mean(c)),
    ("Total {c}", "main without revenue", None, lambda f, c, d: f.total(c), lambda f, c, d: f.mean(c)),
    ("Total Profit", "profit", None, lambda f, c, d: f.total(c), lambda f, c, d: f.mean(c)),
    ("Total Orders", "named order", "unique orders/transactions", lambda f, c, d: f.values(c), None),
    ("Total Orders", "counted order", "unique orders/transactions", lambda f, c, d: f.rows(), None),
    ("Total Orders", "record", "unique records", lambda f, c, d: f.values(c), None),
    ("Total Customers", "customer", "unique customers", lambda f, c, d: f.values(c), None),
    ("Avg Order Value", "revenue per order", "per order", lambda f, c, d: _ratio(f.total(c), f.values(d.order)), None),
    ("Avg Order Value", "revenue per record", "per record", lambda f, c, d: _ratio(f.total(c), f.rows()), None),
    ("Growth %", "growing", "{c} vs. previous period", None, None),
    ("Avg {c}", "other numeric", None, lambda f, c, d: f.mean(c), lambda f, c, d: f.largest(c)),
    ("Unique {c}", "other categorical", "distinct values", lambda f, c, d: f.values(c), None),
    ("Date Range", "dated", None, lambda f, c, d: _days(*f.span(c)), None),
]
# End of fixed values.
# ---------------------------------------------------------------------------


def _ratio(total: F.Column, count: F.Column) -> F.Column:
    return total / F.greatest(count.cast("double"), F.lit(1.0))


def _days(lo: F.Column, hi: F.Column) -> F.Column:
    return F.timestamp_diff("DAY", lo, hi)


def build_kpis(df: DataFrame, profile: Profile, max_kpis: int = R.MAX_KPIS, profile_counts: bool = False) -> DataFrame:
    """K1. ``profile_counts=True`` when ``df`` holds exactly the profiled
    rows: distinct counts are then taken from the profile instead of being
    recounted."""
    s, d = profile.schema, duties(df, profile)
    date, primary = next(iter(s["date"]), None), profile.primary_measure
    trends = _trends(df, date, list(dict.fromkeys(c for c in (d.main, d.profit, primary) if c)))
    countable = d.order in s["id"] or d.order in s["categorical"]
    columns = {
        "any": [None], "revenue": [d.revenue], "main without revenue": [None if d.revenue else d.main],
        "profit": [d.profit], "named order": [d.order if countable else None],
        "counted order": [None if countable else d.order], "record": [d.record], "customer": [d.customer],
        "revenue per order": [d.revenue if d.order else None], "revenue per record": [None if d.order else d.revenue],
        "growing": [primary if trends.get(primary, (None,))[0] is not None else None],
        "other numeric": [c for c in s["numeric"] if c not in d.serving() and c != primary],
        "other categorical": [c for c in s["categorical"] if c not in d.serving()],
        "dated": [date if date and profile.n.get(date, 0) > 0 else None],
    }
    shown = [(step, c) for step in LADDER for c in columns[step[1]] if c is not None or step[1] == "any"][:max_kpis]

    facts, null = Facts(df), F.lit(None).cast("double")
    rows = []
    for i, ((label, duty, text, value, sub), c) in enumerate(shown):
        trending = duty in ("revenue", "main without revenue", "profit", "growing")
        pct, up = trends.get(c, (None, None)) if trending else (None, None)
        text = F.lit(text.format(c=c) if text else None).cast("string")
        if duty == "dated":
            text = F.concat_ws(" – ", *[F.date_format(t, "MMM yyyy") for t in facts.span(c)])
        rows.append(F.struct(
            F.lit(i + 1).cast("long").alias("ord"), F.lit(label.format(c=c)).alias("label"),
            (value(facts, c, d).cast("double") if value else F.lit(pct).cast("double")).alias("value"),
            (sub(facts, c, d).cast("double") if sub else null).alias("sub_value"), text.alias("sub_text"),
            F.lit(pct).cast("double").alias("trend_pct"), F.lit(up).cast("boolean").alias("trend_up")))

    # One fused aggregate; distinct counts from the profile or one grouped pass.
    counts = ({c: profile.nunique[c] for c in facts.distinct} if profile_counts
              else _distinct_counts(df, facts.distinct))
    base = df.agg(*[e.alias(name) for name, e in facts.aggregates.items()]).select(
        "*", *[F.lit(counts.get(c, 0)).cast("long").alias(f"d_{i}") for i, c in enumerate(facts.distinct)])
    return base.select(F.explode(F.array(*rows)).alias("k")).select("k.*")
