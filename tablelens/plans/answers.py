"""Rule-based answers (X2), re-aimed to a table of questions: intent by
keyword tests on the lower-cased text, facts computed once for the data
table (one row, broadcast), answer text by ``format_string``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import qcol
from tablelens.plans.insights import ReportInputs

# Keyword stems of each intent, in the reference's order.
INTENT_WORDS = [
    ("best", ["best", "top", "highest", "leading"]),
    ("worst", ["worst", "lowest", "weak"]),
    ("trend", ["trend", "decreas", "increas", "growth"]),
    ("outliers", ["outlier", "anomal"]),
    ("summary", ["summar", "overview"]),
]


def _any(q, words):
    cond = F.lit(False)
    for w in words:
        cond = cond | q.contains(w)
    return cond


def _commas0(c):
    """'{:,.0f}': half-even on the binary value, thousands separators."""
    return F.format_number(c, 0)


def _plain1(c):
    """'{:.1f}' without separators."""
    return F.regexp_replace(F.format_number(c, 1), ",", "")


def facts(ri: ReportInputs) -> dict:
    """Facts every answer may quote, shared with the insight report (each a
    bounded result computed once per report): leaders and tail of the
    category sums, the last month-over-month change, the first outlier column
    and the table shape."""
    s = ri.profile.schema
    ri.prefetch(["outlier_rows", "health_row", "group_facts", "month_rows"])
    h = ri.health_row()
    f = {"rows": h.get("rows"), "cols": h.get("columns"), "best_label": None, "best_value": None,
         "second_label": None, "worst_label": None, "worst_value": None, "trend_pct": None,
         "o_col": None, "o_n": None, "o_pct": None, "o_max": None,
         "n_num": len(s["numeric"]), "n_cat": len(s["categorical"]), "n_date": len(s["date"])}
    g = ri.group_facts()
    if g:
        f.update(best_label=g["top"][0], best_value=g["top"][1], second_label=g["second"],
                 worst_label=g["low"][0], worst_value=g["low"][1])
    m = ri.month_rows()
    if len(m) >= 2:
        cur, prev = m[-1][1], m[-2][1]
        f["trend_pct"] = (cur - prev) / (abs(prev) + 1e-9) * 100
    o = ri.outlier_rows()
    if o:
        f.update(o_col=o[0]["column"], o_n=o[0]["iqr_outliers"], o_pct=o[0]["pct_of_rows"], o_max=o[0]["max"])
    return f


def answer_questions(questions: DataFrame, qid: list[str], text_col: str, ri: ReportInputs) -> DataFrame:
    """(ids..., intent, answer) for every question."""
    s = ri.profile.schema
    primary = ri.primary
    cat = s["categorical"][0] if s["categorical"] else None
    q = F.lower(qcol(text_col))
    types = {"rows": "long", "cols": "long", "best_label": "string", "best_value": "double",
             "second_label": "string", "worst_label": "string", "worst_value": "double", "trend_pct": "double",
             "o_col": "string", "o_n": "long", "o_pct": "double", "o_max": "double", "n_num": "long",
             "n_cat": "long", "n_date": "long"}
    fx = facts(ri)
    # the facts are literals on every question row (no join)
    j = questions.select(*[qcol(c) for c in qid], q.alias("_q"), *[F.lit(fx[k]).cast(t).alias(k) for k, t in types.items()])
    qq = F.col("_q")
    can_rank = bool(primary and cat)
    can_trend = bool(primary and s["date"])
    intent = (F.when(F.lit(can_rank) & _any(qq, INTENT_WORDS[0][1]) & F.col("best_label").isNotNull(), "best")
              .when(F.lit(can_rank) & _any(qq, INTENT_WORDS[1][1]) & F.col("worst_label").isNotNull(), "worst")
              .when(F.lit(can_trend) & _any(qq, INTENT_WORDS[2][1]) & F.col("trend_pct").isNotNull(), "trend")
              .when(_any(qq, INTENT_WORDS[3][1]), "outliers")
              .when(_any(qq, INTENT_WORDS[4][1]), "summary")
              .otherwise("fallback"))
    p = F.lit(primary or "")
    best = F.format_string("Based on %s, **%s** leads with %s, followed by %s.", p, F.col("best_label"),
                           _commas0(F.col("best_value")), F.coalesce(F.col("second_label"), F.lit("N/A")))
    worst = F.format_string("**%s** has the lowest %s at %s.", F.col("worst_label"), p,
                            _commas0(F.col("worst_value")))
    trend = F.format_string("%s %s by %s%% in the most recent period compared to the one before.", p,
                            F.when(F.col("trend_pct") >= 0, "increased").otherwise("decreased"),
                            _plain1(F.abs(F.col("trend_pct"))))
    outl = F.when(F.col("o_col").isNotNull(), F.format_string(
        "**%s** has %s outlier values (%s%% of rows), ranging up to %s.", F.col("o_col"),
        F.col("o_n").cast("string"), F.col("o_pct").cast("string"), _commas0(F.col("o_max")))).otherwise(
        "No significant outliers were detected in the numeric columns.")
    summary = F.concat(F.format_string(
        "This dataset has **%s rows** and **%s columns**. It includes %s numeric, %s categorical, and %s date column(s).",
        F.format_number(F.col("rows"), 0), F.col("cols").cast("string"), F.col("n_num").cast("string"),
        F.col("n_cat").cast("string"), F.col("n_date").cast("string")),
        F.lit(f" The primary measure appears to be **{primary}**." if primary else ""))
    fallback = F.lit("I can answer questions about top/bottom performers, trends, growth, and outliers "
                     "based on this dataset. Try asking something like \"Which "
                     f"{cat or 'category'} performs best?\"")
    it = F.col("intent")
    answer = (F.when(it == "best", best).when(it == "worst", worst).when(it == "trend", trend)
              .when(it == "outliers", outl).when(it == "summary", summary).otherwise(fallback))
    return j.select(*qid, intent.alias("intent"), *types).select(*qid, "intent", answer.alias("answer"))
