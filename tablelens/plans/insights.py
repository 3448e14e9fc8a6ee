"""Rule-based insight report (I1-I7, A18): every fact is a row
``(section, ord, title, subject, metric, value, body)``.

The numbers come from Spark jobs over the table: the health row, the outlier
table, the month series, aggregates of the category sums (leader, tail,
concentration), one fused aggregate of base facts (maximum, date span, top
record), the strongest correlate, the under-served segment and the weakest
calendar month. Each of those results is bounded (one row, one row per
numeric column, one row per month, top-k rows), so the sections, whose rules
are "missing over 5 %", "leader over half the total", "no risk found", are
assembled from them on the driver into a report of a few dozen rows.

Facts are named: each is one bounded result, found once per report by the first
section (or rule-based answer) that asks for it. What a section needs is found by
concurrent jobs first (``ReportInputs.prefetch``), so that small results do not wait
for each other. Group figures and the month series are cached frames that
several facts read.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import rules as R
from tablelens.functions import scalar as S
from tablelens.functions.columns import as_double, as_timestamp, qcol, scalars
from tablelens.operators import breakdown as B
from tablelens.operators import distribution as D
from tablelens.operators import monthly as M
from tablelens.operators import quality as Q
from tablelens.plans.profile import Profile

SCHEMA = "section string, ord long, title string, subject string, metric string, value double, body string, number double"

#: Stands in a sentence for the row's number as C1 formats it.
NUMBER = "\x01"

# The report's sentences, without the bold marks of a page.
BODY = {
    "overview": "{rows:,} rows × {columns} cols",
    "health": "Health {score}/100 · Grade {grade}",
    "category": "{cat} · {number}",
    "highest": "Max {primary}",
    "coverage": "{n} date column(s)",
    "columns": "{numeric} numeric / {categorical} categorical cols",
    "gaps": "Missing: {missing_pct}% · Dupes: {dup_pct}%",
    "leader": "{label} leads in {primary}, contributing {share:.1f}% of the total.",
    "lowest": "{label} has the lowest total {primary}.",
    "top3": "The top 3 {cat} values account for {share:.1f}% of total {primary}.",
    "record": "Highest {primary} belongs to {label}.",
    "relation": "{primary} is most correlated with {column} (r = {r:.3f}).",
    "recent": "{primary} {direction} {pct:.1f}% in {month:%b %Y} vs the prior month.",
    "best_month": "{month:%B %Y} recorded the highest {primary}.",
    "weakest_month": "{month:%B %Y} recorded the lowest {primary}.",
    "trajectory": "Across the full period, {primary} shows {article} {direction} trend.",
    "missing": "Dataset has {missing_pct}% missing values overall. This can bias aggregates and KPI accuracy.",
    "duplicates": "{dup_rows:,} duplicate rows detected ({dup_pct}% of data). Verify these aren't double-counted in totals.",
    "volatility": "{n} outlier values in {column} ({pct}% of rows). Investigate before relying on averages.",
    "extreme": "{column} has a maximum value ({number}) over {ratio:.0f}x the mean — a small number of extreme records "
               "may be skewing totals.",
    "dependency": "{label} accounts for over {share:.0f}% of total {primary} — performance is highly dependent on a "
                  "single {cat}.",
    "no_risk": "No significant data quality or concentration risks found in this dataset.",
    "underserved": "{label} has a high average {primary} per record but low volume — there may be room to grow share here.",
    "seasonal": "{month} shows the lowest average {primary} historically — a potential target for promotions.",
    "no_chance": "Add more categorical or time-based columns for the engine to identify growth segments.",
    "clean": "Impute or remove records with missing values ({missing_pct}% of cells) before deeper analysis.",
    "deduplicate": "Review and remove the {dup_rows:,} duplicate rows to avoid inflated totals.",
    "focus": "Double down on the best-performing {cat} segments identified above to maximize {primary}.",
    "diversify": "Performance is concentrated in a single segment — consider strategies to diversify revenue sources.",
    "monitor": "The dataset looks healthy. Continue tracking key metrics over time to catch emerging trends early.",
}
# End of fixed values.


def _row(section, ord_, title, subject=None, metric=None, value=None, body=None, number=None, **facts) -> tuple:
    """One fact; ``body`` names its sentence, filled with ``facts``."""
    text = None if body is None else BODY[body].format(number=NUMBER, **facts)
    return (section, int(ord_), title, None if subject is None else str(subject), metric,
            None if value is None else float(value), text, None if number is None else float(number))


def _frame(spark, rows: list[tuple]) -> DataFrame:
    facts = spark.createDataFrame(rows, SCHEMA)
    return facts.withColumn("body", F.replace("body", F.lit(NUMBER), S.fmt_number(F.col("number")))).drop("number")


#: Facts found side by side.
THREADS = 4


@dataclass
class ReportInputs:
    df: DataFrame
    profile: Profile
    cache: bool = True
    exact: bool = True
    _memo: dict[str, Future] = field(default_factory=dict)
    _lock: Lock = field(default_factory=Lock)
    _cached: list[DataFrame] = field(default_factory=list)

    @property
    def cat(self):
        return self.profile.schema["categorical"][0] if self.profile.schema["categorical"] else None

    @property
    def primary(self):
        return self.profile.primary_measure

    @property
    def date(self):
        return self.profile.schema["date"][0] if self.profile.schema["date"] else None

    def _once(self, key, fn):
        """The first caller finds the fact; others wait for it."""
        with self._lock:
            mine = key not in self._memo
            fact = self._memo.setdefault(key, Future())
        if mine:
            try:
                fact.set_result(fn())
            except BaseException as e:
                fact.set_exception(e)
        return fact.result()

    def _keep(self, frame: DataFrame) -> DataFrame:
        if self.cache:
            with self._lock:
                self._cached.append(frame.cache())
        return frame

    # -- frames that several facts read --------------------------------------
    def groups(self) -> DataFrame | None:
        """``group_figures`` of the primary measure by the first category."""
        return self._once("groups frame", lambda: self._keep(B.group_figures(self.df, self.cat, self.primary))
                          if self.primary and self.cat else None)

    def monthly(self) -> DataFrame | None:
        return self._once("months frame", lambda: self._keep(M.monthly_sum(self.df, self.date, self.primary))
                          if self.primary and self.date else None)

    # -- bounded results, each computed once per report ---------------------
    def health_row(self) -> dict:
        return self._once("health", lambda: scalars(Q.health(self.df)))

    def outlier_rows(self) -> list:
        """``exact=False``: sketch quartiles (one pass, for very large tables)."""
        return self._once("outliers", lambda: D.outliers(self.df, self.profile.schema["numeric"], exact=self.exact)
                          .orderBy("position").collect())

    def month_rows(self) -> list:
        """(month, value) of the dense month series, one row per month."""
        return self._once("months", lambda: [] if self.monthly() is None else
                          [(r["month"], r["value"]) for r in self.monthly().orderBy("month").collect()])

    def trend_facts(self) -> list:
        """(kind, month, value, direction) of W6, W7 and W8 over the month series: one job."""
        def run():
            m = self.monthly()
            if m is None:
                return []
            none = F.lit(None)
            recent = M.mom_trend_of(m).select(F.lit("recent").alias("kind"), "month", F.col("pct").alias("value"), "direction")
            ends = M.best_worst_month_of(m).select("kind", "month", "value", none.cast("string").alias("direction"))
            slope = M.trajectory_of(m).select(F.lit("trajectory").alias("kind"), none.cast("date").alias("month"),
                                              F.col("slope").alias("value"), "direction")
            found = {r["kind"]: r for r in recent.unionByName(ends).unionByName(slope).collect()}
            return [found[k] for k in ("recent", "best", "worst", "trajectory") if k in found]
        return self._once("trends", run)

    def strongest(self) -> list:
        """A18, of at least two numeric columns."""
        s = self.profile.schema
        return self._once("strongest", lambda: D.strongest_corr(self.df, self.primary, s["numeric"]).collect()
                          if len(s["numeric"]) >= 2 and self.primary in s["numeric"] else [])

    def underserved(self) -> list:
        return self._once("underserved", lambda: [] if self.groups() is None else B.underserved_of(self.groups()).collect())

    def seasonal_low(self) -> list:
        return self._once("seasonal", lambda: M.seasonal_low(self.df, self.date, self.primary).collect()
                          if self.date and self.primary else [])

    def prefetch(self, facts: list[str]) -> None:
        """Find the named facts by concurrent jobs, the longest first."""
        with ThreadPoolExecutor(max_workers=THREADS) as pool:
            for found in [pool.submit(getattr(self, f)) for f in facts]:
                found.result()

    def group_facts(self) -> dict:
        """Leader, runner-up, tail, group count, total and top-3 sum of the
        category sums (a three-row top-k and one aggregate)."""
        def run():
            g = self.groups()
            if g is None:
                return {}
            top3 = g.orderBy(F.col("value").desc(), F.col("label").asc()).limit(3).collect()
            if not top3:
                return {}
            a = scalars(g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
                              F.min(F.struct("value", "label")).alias("lo")))
            return {"n": a["n"], "total": a["total"], "top": (top3[0]["label"], top3[0]["value"]),
                    "second": top3[1]["label"] if len(top3) > 1 else None,
                    "low": (a["lo"]["label"], a["lo"]["value"]), "t3": sum(r["value"] for r in top3)}
        return self._once("groups", run)

    def release(self) -> None:
        """Drop the cached inputs; the facts read so far stay."""
        while self._cached:
            self._cached.pop().unpersist()

    def base_facts(self) -> dict:
        """One aggregate over the rows: maximum of the primary measure, first
        and last date, and the top record (largest measure, largest category
        text among equal maxima: rows have no file order)."""
        def run():
            df, aggs = self.df, []
            if self.primary:
                v = as_double(df, self.primary)
                aggs.append(F.max(v).alias("mx"))
                if self.cat:
                    top = F.struct(v.alias("value"), qcol(self.cat).cast("string").alias("label"))
                    aggs.append(F.max(F.when(v.isNotNull(), top)).alias("top"))
            if self.date:
                t = as_timestamp(df, self.date)
                aggs += [F.min(t).alias("lo"), F.max(t).alias("hi")]
            return scalars(df.agg(*aggs)) if aggs else {}
        return self._once("base", run)


def report_inputs(df: DataFrame, profile: Profile, cache: bool = True, exact: bool = True) -> ReportInputs:
    """What the sections of a report share; nothing runs yet. ``cache``: the group
    figures and the month series are cached (recomputed from lineage if a cached
    block is lost). ``exact=False``: sketch quartiles for the outlier table (one
    pass, for very large tables)."""
    return ReportInputs(df, profile, cache, exact)


def _mon(d, long: bool = False) -> str:
    return d.strftime("%B %Y" if long else "%b %Y")


# ------------------------------------------------------------------------ I1
def executive_rows(ri: ReportInputs) -> list[tuple]:
    s, h, sec = ri.profile.schema, ri.health_row(), "executive_summary"
    rows = [_row(sec, 1, "Dataset Overview", None, "rows", h["rows"], "overview", **h),
            _row(sec, 2, "Dataset Overview", None, "columns", h["columns"]),
            _row(sec, 3, "Health Score", h["grade"], "score", h["score"], "health", **h)]
    g = ri.group_facts()
    if g:
        rows += [_row(sec, 4, "Best Category", g["top"][0], ri.cat, g["top"][1], "category", g["top"][1], cat=ri.cat),
                 _row(sec, 5, "Worst Category", g["low"][0], ri.cat, g["low"][1], "category", g["low"][1], cat=ri.cat)]
    b = ri.base_facts()
    if ri.primary:
        rows.append(_row(sec, 6, "Highest Value", ri.primary, "max", b.get("mx"), "highest", primary=ri.primary))
    if ri.date and b.get("lo") is not None:
        rows.append(_row(sec, 7, "Date Coverage", f"{_mon(b['lo'])} → {_mon(b['hi'])}", "date_columns",
                         len(s["date"]), "coverage", n=len(s["date"])))
    rows += [_row(sec, 8, "Key Observation", None, "numeric_columns", len(s["numeric"]), "columns",
                  numeric=len(s["numeric"]), categorical=len(s["categorical"])),
             _row(sec, 9, "Key Observation", None, "categorical_columns", len(s["categorical"])),
             _row(sec, 10, "Key Observation", None, "missing_pct", h["missing_pct"], "gaps", **h),
             _row(sec, 11, "Key Observation", None, "dup_pct", h["dup_pct"])]
    return rows


# ------------------------------------------------------------------------ I2
def business_rows(ri: ReportInputs) -> list[tuple]:
    sec, rows = "business_insights", []
    g = ri.group_facts()
    if g:
        total, own = g["total"], {"cat": ri.cat, "primary": ri.primary}
        lead, t3 = ((x / total * 100 if total else 0.0) for x in (g["top"][1], g["t3"]))
        rows += [_row(sec, 1, "Best Category", g["top"][0], "share_pct", lead, "leader", label=g["top"][0], share=lead, **own),
                 _row(sec, 2, "Lowest Performance", g["low"][0], ri.primary, g["low"][1], "lowest", label=g["low"][0], **own)]
        if g["n"] >= 3:
            rows.append(_row(sec, 3, "Concentration", ri.cat, "top3_share_pct", t3, "top3", share=t3, **own))
        top = ri.base_facts().get("top")
        if top is not None:
            label = top["label"]
            rows.append(_row(sec, 4, "Top Record", label, ri.primary, top["value"], "record", label=str(label)[:40], **own))
    for r in ri.strongest():
        rows.append(_row(sec, 5, "Strongest Relationship", r["column"], "r", r["r"], "relation", primary=ri.primary, **r.asDict()))
    return rows


# ------------------------------------------------------------------------ I3
def trend_rows(ri: ReportInputs) -> list[tuple]:
    """W6, W7 and W8 over the report's month series."""
    sec, own, rows = "trend_analysis", {"primary": ri.primary}, []
    for r in ri.trend_facts():
        kind, month, value, direction = r
        if kind == "recent":
            rows.append(_row(sec, 1, "Recent Trend", _mon(month), direction, value, "recent",
                             direction=direction, pct=abs(value), month=month, **own))
        elif kind == "trajectory":
            rows.append(_row(sec, 4, "Overall Trajectory", direction, "slope", value, "trajectory",
                             direction=direction, article="an" if direction == "upward" else "a", **own))
        else:
            ord_, title, body = {"best": (2, "Best Month", "best_month"), "worst": (3, "Weakest Month", "weakest_month")}[kind]
            rows.append(_row(sec, ord_, title, _mon(month, True), "total", value, body, month=month, **own))
    return rows


# ------------------------------------------------------------------------ I4
def risk_rows(ri: ReportInputs) -> list[tuple]:
    h, sec, rows = ri.health_row(), "risk_detection", []
    if h["missing_pct"] > R.RISK_MISSING_PCT:
        rows.append(_row(sec, 1, "Data Quality Risk", None, "missing_pct", h["missing_pct"], "missing", **h))
    if h["dup_pct"] > R.RISK_DUPLICATE_PCT:
        rows.append(_row(sec, 2, "Duplicate Records", None, "dup_rows", h["dup_rows"], "duplicates", **h))
    for o in ri.outlier_rows():
        if o["pct_of_rows"] > R.RISK_OUTLIER_PCT:
            rows.append(_row(sec, 10 + o["position"], f"Volatility in {o['column']}", o["column"], "pct_of_rows",
                             o["pct_of_rows"], "volatility", n=o["iqr_outliers"], column=o["column"], pct=o["pct_of_rows"]))
        elif o["mean"] not in (0, None):
            ratio = abs(o["max"]) / (abs(o["mean"]) + R.EPSILON)
            if ratio > R.RISK_MAX_TO_MEAN and o["iqr_outliers"] > 0:
                rows.append(_row(sec, 10 + o["position"], f"Extreme Value in {o['column']}", o["column"],
                                 "max_to_mean", ratio, "extreme", o["max"], column=o["column"], ratio=ratio))
    g = ri.group_facts()
    if g and g["total"] and g["top"][1] / g["total"] > R.RISK_LEADER_SHARE:
        share = g["top"][1] / g["total"] * 100
        rows.append(_row(sec, 100, "Concentration Risk", g["top"][0], "share_pct", share, "dependency",
                         label=g["top"][0], share=share, primary=ri.primary, cat=ri.cat))
    return rows or [_row(sec, 1, "No Major Risks Detected", body="no_risk")]


# ------------------------------------------------------------------------ I5
def opportunity_rows(ri: ReportInputs) -> list[tuple]:
    sec, rows = "opportunities", []
    for u in ri.underserved():
        rows.append(_row(sec, 1, "Under-served Segment", u["label"], "avg", u["avg_value"], "underserved",
                         label=u["label"], primary=ri.primary))
    for m in ri.seasonal_low():
        rows.append(_row(sec, 2, "Seasonal Opportunity", m["month_name"], "avg", m["avg_value"], "seasonal",
                         month=m["month_name"], primary=ri.primary))
    return rows or [_row(sec, 1, "No Clear Opportunities Surfaced", body="no_chance")]


# ------------------------------------------------------------------------ I6
def recommendation_rows(ri: ReportInputs, risks: list[tuple] | None = None) -> list[tuple]:
    h, sec, rows = ri.health_row(), "recommendations", []
    if h["missing_pct"] > R.RISK_MISSING_PCT:
        rows.append(_row(sec, 1, "Clean Missing Data", None, "missing_pct", h["missing_pct"], "clean", **h))
    if h["dup_rows"] > 0:
        rows.append(_row(sec, 2, "Deduplicate Records", None, "dup_rows", h["dup_rows"], "deduplicate", **h))
    if ri.primary and ri.cat:
        rows.append(_row(sec, 3, "Focus on Top Performers", ri.cat, body="focus", cat=ri.cat, primary=ri.primary))
    risks = risks if risks is not None else risk_rows(ri)
    if any(r[2] == "Concentration Risk" for r in risks):
        rows.append(_row(sec, 4, "Diversify Dependency", body="diversify"))
    return (rows or [_row(sec, 1, "Keep Monitoring", body="monitor")])[:R.MAX_RECOMMENDATIONS]


# ----------------------------------------------------------- section frames
#: The facts of each section, those that take longest first.
RISK_FACTS = ["outlier_rows", "health_row", "group_facts"]
CHANCE_FACTS = ["underserved", "seasonal_low"]
BUSINESS_FACTS = ["strongest", "group_facts", "base_facts"]


def _section(ri: ReportInputs, rows, facts: list[str]) -> DataFrame:
    """The frame of one section; the report's cached inputs are released."""
    try:
        ri.prefetch(facts)
        return _frame(ri.df.sparkSession, rows(ri))
    finally:
        ri.release()


def executive_summary(ri: ReportInputs) -> DataFrame:
    return _section(ri, executive_rows, ["health_row", "group_facts", "base_facts"])


def business_insights(ri: ReportInputs) -> DataFrame:
    return _section(ri, business_rows, BUSINESS_FACTS)


def trend_analysis(ri: ReportInputs) -> DataFrame:
    return _section(ri, trend_rows, ["trend_facts"])


def risks(ri: ReportInputs) -> DataFrame:
    return _section(ri, risk_rows, RISK_FACTS)


def opportunities(ri: ReportInputs) -> DataFrame:
    return _section(ri, opportunity_rows, CHANCE_FACTS)


def recommendations(ri: ReportInputs) -> DataFrame:
    return _section(ri, recommendation_rows, RISK_FACTS)


# ------------------------------------------------------------------------ I7
def insight_report(df: DataFrame, profile: Profile, ri: ReportInputs | None = None,
                   exact: bool = True) -> DataFrame:
    """All sections plus the health figures and the outlier table, as one
    frame with a ``section`` column."""
    facts = dict.fromkeys(["outlier_rows", "underserved", "health_row", "trend_facts", *CHANCE_FACTS, *BUSINESS_FACTS])
    return _section(ri or report_inputs(df, profile, exact=exact), report_rows, list(facts))


def report_rows(ri: ReportInputs) -> list[tuple]:
    h = ri.health_row()
    rows = [_row("health", i + 1, "Health", h["grade"], m, h[m])
            for i, m in enumerate(["score", "missing_pct", "missing_cells", "dup_rows", "dup_pct", "total_cells"])]
    r = risk_rows(ri)
    rows += executive_rows(ri) + business_rows(ri) + trend_rows(ri) + r + opportunity_rows(ri)
    rows += recommendation_rows(ri, r)
    return rows + [_row("outliers", o["position"], "Outliers", o["column"], "iqr_outliers", o["iqr_outliers"])
                   for o in ri.outlier_rows()]
