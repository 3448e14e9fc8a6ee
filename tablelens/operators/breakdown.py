"""Category breakdowns: group sums, top-N, shares, Pareto, best/worst,
concentration, top record, under-served segment, top-k membership
(A1-A5, W4, A15-A17, A19, F6).

Every op starts from ``group_sum``: rows with a null key are dropped, the
measure is summed with NaN/null skipped and an all-missing group sums to 0.
``groupBy`` aggregates partially on the map side, so a key holding a third of
all rows costs one partial row per task, not a hot reducer. Top-N selection
is ``orderBy(...).limit(n)`` (TakeOrderedAndProject: each task keeps n rows).
Ties are broken by the key ascending, which makes every result deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions import rules as R

from tablelens.functions.columns import as_double, qcol


def group_sum(df: DataFrame, x: str, y: str) -> DataFrame:
    """(label string, value double) for every non-null key."""
    return (df.where(qcol(x).isNotNull())
            .groupBy(qcol(x).cast("string").alias("label"))
            .agg(F.coalesce(F.sum(as_double(df, y)), F.lit(0.0)).alias("value")))


def group_figures(df: DataFrame, x: str, y: str) -> DataFrame:
    """(label string, value double, n long): sum and number of the measure's
    values for every non-null key."""
    v = as_double(df, y)
    return (df.where(qcol(x).isNotNull())
            .groupBy(qcol(x).cast("string").alias("label"))
            .agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("value"), F.count(v).alias("n")))


def group_count(df: DataFrame, x: str) -> DataFrame:
    """(label, count) value counts, null keys dropped."""
    return (df.where(qcol(x).isNotNull())
            .groupBy(qcol(x).cast("string").alias("label"))
            .agg(F.count(F.lit(1)).alias("count")))


def _top(g: DataFrame, n: int, by: str = "value") -> DataFrame:
    top = g.orderBy(F.col(by).desc(), F.col("label").asc()).limit(n)
    # rank over <= n rows: a window without partition on a bounded frame.
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col(by).desc(), F.col("label").asc())).cast("long"))


#: Buckets of labels, and how many of the fullest are counted first, per wanted label.
TOP_BUCKETS, TOP_FIRST = 1 << 16, 4


def _of_many(df: DataFrame, x: str, y: str | None, n: int, buckets: int = TOP_BUCKETS) -> DataFrame:
    """The rows of ``df`` that can hold the ``n`` largest groups of ``x`` (by sum of
    ``y``, else by count), for columns with far too many labels to shuffle.

    Labels are hashed into ``buckets``; one pass sums each bucket's positive values
    (or counts its rows), which no label in it can exceed. A second pass finds the
    exact groups of the fullest buckets; their ``n``-th figure is one that the answer
    reaches, so only buckets whose bound is not below it can hold another label of the
    answer. The result is exact whatever the data: where half of the buckets qualify
    (flat columns) all rows are returned. The driver holds one number a bucket."""
    bucket = F.pmod(F.xxhash64(qcol(x).cast("string")), F.lit(buckets)).cast("int")
    rows = df.where(qcol(x).isNotNull())
    most = F.coalesce(F.sum(F.greatest(as_double(df, y), F.lit(0.0))), F.lit(0.0)) if y else F.count(F.lit(1)).cast("double")
    bounds = sorted(((r["m"], r["b"]) for r in rows.groupBy(bucket.alias("b")).agg(most.alias("m")).collect()), reverse=True)

    def within(ids: list[int]) -> DataFrame:
        chosen = df.sparkSession.createDataFrame([(i,) for i in ids], "_b int")
        return rows.join(F.broadcast(chosen), bucket == chosen["_b"], "left_semi")

    first = [b for _, b in bounds[:TOP_FIRST * n]]
    if not first or 2 * len(first) > len(bounds):
        return rows
    groups = group_sum(within(first), x, y) if y else group_count(within(first), x).withColumnRenamed("count", "value")
    reached = [r["value"] for r in groups.orderBy(F.col("value").desc()).limit(n).collect()]
    if len(reached) < n or not math.isfinite(reached[-1]):
        return rows
    slack = 1e-6 * abs(reached[-1])  # sums of doubles depend on their order
    ids = [b for m, b in bounds if m >= reached[-1] - slack]
    return rows if 2 * len(ids) > len(bounds) else within(ids)


def bar_top(df: DataFrame, x: str, y: str, n: int = R.TOP_BAR, many: bool = False) -> DataFrame:
    """A1: top ``n`` categories by summed measure. ``many``: there are so many
    categories that only those that can be among the top are to be shuffled (two
    more scans, same rows)."""
    return _top(group_sum(_of_many(df, x, y, n) if many else df, x, y), n)


def category_frequency(df: DataFrame, x: str, n: int = R.TOP_FREQUENCY, many: bool = False) -> DataFrame:
    """A2: the ``n`` most frequent values (count desc, value asc); ``many`` as in ``bar_top``."""
    return _top(group_count(_of_many(df, x, None, n) if many else df, x), n, by="count")


def share(df: DataFrame, x: str, y: str | None = None, n: int = R.TOP_SHARE) -> DataFrame:
    """A3/A5: top ``n`` slices by sum (or by row count without ``y``) and each
    slice's percent of the slices shown."""
    g = group_sum(df, x, y) if y else group_count(df, x).select(
        "label", F.col("count").cast("double").alias("value"))
    top = _top(g, n)
    return top.withColumn("pct", F.try_divide(F.col("value") * 100,
                                              F.sum("value").over(Window.partitionBy())))


def treemap(df: DataFrame, x: str, y: str) -> DataFrame:
    """A4: sum for every category (no cap)."""
    return group_sum(df, x, y)


def funnel(df: DataFrame, x: str, y: str, n: int = R.TOP_FUNNEL) -> DataFrame:
    """A5: top 8 stages by sum, percent of the stages shown."""
    return share(df, x, y, n)


def pareto(df: DataFrame, x: str, y: str, n: int = R.TOP_PARETO) -> DataFrame:
    """Top ``n`` by sum with the cumulative percent of the shown total."""
    top = _top(group_sum(df, x, y), n)
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return top.withColumn("cumulative_pct", F.try_divide(
        F.sum("value").over(w) * 100, F.sum("value").over(Window.partitionBy())))


def best_worst(df: DataFrame, x: str, y: str) -> DataFrame:
    """Best and runner-up (largest sums) and worst (smallest sum); the
    smallest key wins ties at both ends."""
    g = group_sum(df, x, y)
    top2 = _top(g, 2).select(F.when(F.col("rank") == 1, "best").otherwise("second").alias("kind"),
                             "label", "value")
    worst = (g.orderBy(F.col("value").asc(), F.col("label").asc()).limit(1)
             .select(F.lit("worst").alias("kind"), "label", "value"))
    return top2.unionByName(worst)


def concentration(df: DataFrame, x: str, y: str) -> DataFrame:
    """Total, number of groups, leader's share and the top-3 share (when
    there are at least 3 groups); ``concentrated`` when the leader's share of
    the total exceeds one half."""
    return concentration_of(group_sum(df, x, y))


def concentration_of(g: DataFrame) -> DataFrame:
    """A16 over ready (label, value) group sums. The top three sums are a
    three-row top-k, taken to the driver and used as a literal."""
    from tablelens.functions.columns import scalars
    t3 = scalars(g.orderBy(F.col("value").desc(), F.col("label").asc()).limit(3)
                 .agg(F.sum("value").alias("t3"))).get("t3")
    ranked = g.withColumn("desc_key", F.struct(F.negative("value").alias("nv"), "label"))
    a = ranked.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("value").alias("total"),
                   F.min("desc_key").alias("top1"))
    top, total = F.negative(F.col("top1.nv")), F.col("total")
    return a.where(F.col("n_groups") > 0).select(
        "n_groups", "total", F.col("top1.label").alias("top_label"), top.alias("top_value"),
        F.when(total != 0, top / total * 100).otherwise(0.0).alias("top_share_pct"),
        F.when(F.col("n_groups") >= 3, F.when(total != 0, F.lit(t3).cast("double") / total * 100).otherwise(0.0))
        .alias("top3_share_pct"),
        (F.coalesce(F.try_divide(top, total), F.lit(0.0)) > 0.5).alias("concentrated"))


def top_record(df: DataFrame, x: str, y: str) -> DataFrame:
    """Category of the row with the largest measure (the largest
    category text among equal maxima: rows have no file order here)."""
    v = as_double(df, y)
    m = df.where(v.isNotNull()).agg(F.max(F.struct(v.alias("value"),
                                                   qcol(x).cast("string").alias("label"))).alias("m"))
    return m.where(F.col("m").isNotNull()).select(F.col("m.label").alias("label"),
                                                  F.col("m.value").alias("value"))


def top_k_members(df: DataFrame, x: str, k: int, many: bool = False) -> DataFrame:
    """rows whose ``x`` is one of the ``k`` most frequent values. The
    top-k frame has k rows, so it is broadcast into a left-semi join. ``many`` as
    in ``bar_top``."""
    top = category_frequency(df, x, k, many).select(F.col("label").alias("_k"))
    return df.join(F.broadcast(top), qcol(x).cast("string") == F.col("_k"), "left_semi")


def underserved(df: DataFrame, x: str, y: str, min_count: int = R.UNDERSERVED_MIN_COUNT) -> DataFrame:
    """Groups with at least ``min_count`` rows whose count is below the
    median group count and whose mean is above the median group mean; the one
    with the highest mean (smallest key on ties)."""
    g = group_figures(df, x, y).persist()  # read by the median jobs and by the final filter
    try:
        return underserved_of(g, min_count)
    finally:
        g.unpersist()


def underserved_of(figures: DataFrame, min_count: int = R.UNDERSERVED_MIN_COUNT) -> DataFrame:
    """A19 over ready ``group_figures``, which are read several times."""
    from tablelens.operators.quantiles import exact_quantiles
    g = figures.where(F.col("n") >= min_count).withColumn("avg_value", F.col("value") / F.col("n"))
    long_df = g.select(F.lit("n").alias("key"), F.col("n").cast("double").alias("val")).unionByName(
        g.select(F.lit("avg").alias("key"), F.col("avg_value").alias("val")))
    med, rows = exact_quantiles(long_df, "key", "val", [0.5]), []
    if "n" in med:
        below, above = F.col("n") < F.lit(med["n"][0.5]), F.col("avg_value") > F.lit(med["avg"][0.5])
        rows = (g.where(below & above).orderBy(F.col("avg_value").desc(), F.col("label").asc()).limit(1)
                .select("label", F.col("n").cast("long"), "avg_value").collect())
    return figures.sparkSession.createDataFrame(rows, "label string, n long, avg_value double")
