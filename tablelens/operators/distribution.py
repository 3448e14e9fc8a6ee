"""Distributions and statistics: histogram, five-number summaries, violin
bins, outliers, correlations, scatter sample, column descriptions
(A7, A8, A8b, A10, A11, A18, A21, P7).

Quantiles come from ``quantiles.exact_quantiles`` (counting search, bounded
band), never from a single-task value map. Per-column statistics are fused
into one aggregate over all columns, so k columns cost one scan, not k.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import rules as R
from tablelens.functions.columns import as_double, as_timestamp, present, qcol, sql_literal
from tablelens.operators.breakdown import category_frequency
from tablelens.operators.comoments import correlations
from tablelens.operators.quantiles import bounds_of, brackets, column_quantiles, exact_quantiles, sketch


# --------------------------------------------------------------------------- A7
def _bin_expr(v, mn, mx, bins: int):
    """1-based equal-width bin; the maximum falls in the last bin and a
    constant column puts everything in bin 1. Same arithmetic as the SQL
    oracle, so edge values land in the same bin."""
    raw = F.floor((v - mn) * bins / (mx - mn)) + 1
    return F.when(mx > mn, F.least(raw, F.lit(bins))).otherwise(F.lit(1)).cast("long")


def histogram(df: DataFrame, y: str, bins: int = R.HISTOGRAM_BINS, bounds: tuple | None = None) -> DataFrame:
    """(bin, lo, hi, count) for ``bins`` equal-width bins between the min and
    max of the non-missing values; empty bins are listed with 0. ``bounds``:
    the (min, max) when already known (e.g. from the profile)."""
    from tablelens.functions.columns import scalars
    v = df.select(as_double(df, y).alias("v")).where(F.col("v").isNotNull())
    b = ({"mn": bounds[0], "mx": bounds[1]} if bounds is not None
         else scalars(v.agg(F.min("v").alias("mn"), F.max("v").alias("mx"))))  # two scalars
    spark = df.sparkSession
    if b.get("mn") is None:
        return spark.createDataFrame([], "bin long, lo double, hi double, count long")
    mn, mx = F.lit(b["mn"]).cast("double"), F.lit(b["mx"]).cast("double")
    nb = bins if b["mx"] > b["mn"] else 1
    counts = v.groupBy(_bin_expr(F.col("v"), mn, mx, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (mx - mn) / F.lit(nb)
    return (spark.range(1, nb + 1).withColumnRenamed("id", "bin")
            .join(F.broadcast(counts), "bin", "left")  # <= bins rows
            .select("bin", (mn + (F.col("bin") - 1) * width).alias("lo"), (mn + F.col("bin") * width).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


# --------------------------------------------------------------------------- A8
def _box_frame(spark, stats: list[tuple]) -> DataFrame:
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("q1", T.DoubleType()), T.StructField("median", T.DoubleType()),
                           T.StructField("q3", T.DoubleType())])
    return spark.createDataFrame(stats, schema)


def _box_finish(long_df: DataFrame, stats: DataFrame) -> DataFrame:
    """Whiskers (most extreme values inside the 1.5·IQR fences), outlier
    counts and notch bounds (median ± 1.57·IQR/√n) per label."""
    iqr = F.col("q3") - F.col("q1")
    s = stats.select("*", iqr.alias("iqr"), (F.col("q1") - 1.5 * iqr).alias("lower_fence"),
                     (F.col("q3") + 1.5 * iqr).alias("upper_fence"))
    v = F.col("v")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    w = (long_df.join(F.broadcast(s.select("label", "lower_fence", "upper_fence")), "label")
         .groupBy("label").agg(F.min(F.when(inside, v)).alias("whisker_low"),
                               F.max(F.when(inside, v)).alias("whisker_high"),
                               F.count_if(~inside).alias("outliers")))
    notch = 1.57 * F.col("iqr") / F.sqrt(F.col("n"))
    return (s.join(w, "label", "left")
            .select("label", "n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                    "whisker_low", "whisker_high", (F.col("median") - notch).alias("notch_low"),
                    (F.col("median") + notch).alias("notch_high"),
                    F.coalesce(F.col("outliers"), F.lit(0)).cast("long").alias("outliers")))


def box_by_category(df: DataFrame, x: str, y: str, k: int = R.TOP_BOX, exact: bool = True) -> DataFrame:
    """Five-number summary of ``y`` for each of the ``k`` most frequent
    values of ``x`` (``exact=False``: sketch quartiles, one pass)."""
    top = category_frequency(df, x, k).select(F.col("label").alias("_k"))
    long_df = (df.join(F.broadcast(top), qcol(x).cast("string") == F.col("_k"), "left_semi")
               .select(qcol(x).cast("string").alias("label"), as_double(df, y).alias("v"))
               .where(F.col("v").isNotNull()))
    q = exact_quantiles(long_df, "label", "v", [0.25, 0.5, 0.75], exact=exact)
    stats = _box_frame(df.sparkSession, [(lab, d["n"], d[0.25], d[0.5], d[0.75]) for lab, d in q.items()])
    return _box_finish(long_df, stats)


def box_columns(df: DataFrame, cols: Sequence[str], top: int = 2, exact: bool = True) -> DataFrame:
    """A8 (per column): summaries of the ``top`` columns with the most IQR
    outliers (column order on ties)."""
    o = outliers(df, cols, max_cols=len(cols), exact=exact).orderBy(F.col("iqr_outliers").desc(),
                                                                     "position").limit(top)
    chosen = [r["column"] for r in o.select("column").collect()]
    if not chosen:
        return _box_finish(df.sparkSession.createDataFrame([], "label string, v double"),
                           _box_frame(df.sparkSession, []))
    wide = df.select(*[as_double(df, c).alias(c) for c in chosen])
    long_df = wide.unpivot([], [qcol(c) for c in chosen], "label", "v").where(F.col("v").isNotNull())
    q = exact_quantiles(long_df, "label", "v", [0.25, 0.5, 0.75], exact=exact)
    stats = _box_frame(df.sparkSession, [(c, d["n"], d[0.25], d[0.5], d[0.75]) for c, d in q.items()])
    return _box_finish(long_df, stats)


# -------------------------------------------------------------------------- A8b
def _violin_counts(df: DataFrame, x: str, y: str, k: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """Rows per (label, bin), and per label of the ``k`` most frequent ones the
    bounds (mn, mx), count n and deviation sd of ``y``."""
    top = category_frequency(df, x, k).select(F.col("label").alias("_k"))
    long_df = (df.join(F.broadcast(top), qcol(x).cast("string") == F.col("_k"), "left_semi")
               .select(qcol(x).cast("string").alias("label"), as_double(df, y).alias("v"))
               .where(F.col("v").isNotNull()))
    b = long_df.groupBy("label").agg(F.min("v").alias("mn"), F.max("v").alias("mx"),
                                     F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    counts = (long_df.join(F.broadcast(b), "label")
              .groupBy("label", _bin_expr(F.col("v"), F.col("mn"), F.col("mx"), bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    return counts, b


def violin_bins(df: DataFrame, x: str, y: str, k: int = R.TOP_VIOLIN, bins: int = R.HISTOGRAM_BINS) -> DataFrame:
    """Per-category ``bins``-bin histograms of ``y`` (each over its own
    min..max) for the ``k`` most frequent categories."""
    counts, b = _violin_counts(df, x, y, k, bins)
    nb = F.when(F.col("mx") > F.col("mn"), F.lit(bins)).otherwise(F.lit(1))
    spine = b.select("label", "mn", "mx",
                     F.explode(F.sequence(F.lit(1).cast("long"), nb.cast("long"))).alias("bin"))
    width = (F.col("mx") - F.col("mn")) / nb
    return (spine.join(counts, ["label", "bin"], "left")
            .select("label", "bin", (F.col("mn") + (F.col("bin") - 1) * width).alias("lo"),
                    (F.col("mn") + F.col("bin") * width).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def violin_density(df: DataFrame, x: str, y: str, k: int = R.TOP_VIOLIN, bins: int = R.DENSITY_BINS,
                   points: int = R.DENSITY_POINTS) -> DataFrame:
    """The Gaussian kernel density of ``y`` for the ``k`` most frequent
    categories, as (label, point, x, density) at ``points`` even places from two
    bandwidths below the minimum to two above the maximum. The bandwidth is
    1.059 sd n^(-1/5); the kernel is laid over the counts of ``bins`` bins, so
    rows are read for the counts only and the curve costs bins x points a
    category. A category with one distinct value has no curve and is left out."""
    counts, b = _violin_counts(df, x, y, k, bins)
    shape = b.where("mx > mn").select("label", "mn", "mx", "n", (1.059 * F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    width = (F.col("mx") - F.col("mn")) / bins
    cells = (counts.join(F.broadcast(shape), "label")  # at most k rows
             .select("label", "mn", "mx", "n", "h", "count", (F.col("mn") + (F.col("bin") - 0.5) * width).alias("at"))
             .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))))
    low, high = F.col("mn") - 2 * F.col("h"), F.col("mx") + 2 * F.col("h")
    cells = cells.withColumn("x", low + F.col("point") * ((high - low) / (points - 1)))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("at")) / F.col("h"), F.lit(2)))
    return (cells.groupBy("label", F.col("point").cast("long").alias("point"))
            .agg(F.min("x").alias("x"), F.sum(F.col("count") * kernel / (F.col("n") * F.col("h") * (2 * math.pi) ** 0.5)).alias("density")))


# -------------------------------------------------------------------------- A10
def outliers(df: DataFrame, cols: Sequence[str], max_cols: int | None = None, min_values: int = R.OUTLIER_MIN_VALUES,
             exact: bool = True) -> DataFrame:
    """A10: per numeric column (all, or the first ``max_cols``; at least ``min_values``
    values): IQR-fence and |z|>3 outlier counts, min/max/mean/std (2 dp) and
    the IQR outliers as a percent of the column's values (2 dp).
    Three scans in all: figures with
    sketches, quartiles counted inside their brackets, outliers (``exact=False``:
    sketch quartiles, two)."""
    cols = list(cols)[:max_cols]
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column string, position long, iqr_outliers long, "
                                      "zscore_outliers long, min double, max double, mean double, "
                                      "std double, pct_of_rows double, q1 double, q3 double")
    if not cols:
        return empty
    vals = [as_double(df, c) for c in cols]
    probs, at = [0.25, 0.75], range(len(cols))
    figures = [f for i, v in enumerate(vals) for f in (F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"))]
    if exact:  # counts, bounds and the brackets of the quartiles come with the same scan
        row = df.agg(*figures, *[sketch(v).alias(f"k{i}") for i, v in enumerate(vals)])
        row = row.select("*", *[brackets(F.col(f"k{i}"), probs).alias(f"b{i}") for i in at]).drop(*[f"k{i}" for i in at])
    else:
        row = df.agg(*figures, *[F.struct(F.count(v), F.array(F.min(v), F.max(v))).alias(f"b{i}") for i, v in enumerate(vals)])
    st = row.collect()[0]
    bounds = {c: bounds_of(st[f"b{i}"]) for i, c in enumerate(cols)}
    keep = [i for i, c in enumerate(cols) if bounds[c][0] >= max(1, min_values)]
    if not keep:
        return empty
    q = column_quantiles(df, [cols[i] for i in keep], probs, exact=exact, bounds=bounds)
    # all but the two counts is known by now; SQL text, as every Column made in Python is a call into the JVM
    number = lambda x: "cast(null as double)" if x is None else f"cast('{x!r}' as double)"
    counts, rows = [], []
    for i in keep:
        (n, low, high, _), mean, std, d = bounds[cols[i]], st[f"m{i}"], st[f"s{i}"], q[cols[i]]
        q1, q3 = d[0.25], d[0.75]
        lo, hi = number(q1 - R.IQR_FACTOR * (q3 - q1)), number(q3 + R.IQR_FACTOR * (q3 - q1))
        spread = number(None if std is None else std + R.EPSILON)
        counts += [F.expr(f"count_if(v{i} < {lo} or v{i} > {hi}) as o{i}"),
                   F.expr(f"count_if(abs((v{i} - {number(mean)}) / {spread}) > {R.Z_CUT}) as z{i}")]
        rows.append(f"named_struct('column', {sql_literal(cols[i])}, 'position', {i}L, 'iqr_outliers', o{i}, 'zscore_outliers', z{i}, "
                    f"'min', round({number(low)}, 2), 'max', round({number(high)}, 2), 'mean', round({number(mean)}, 2), 'std', round({number(std)}, 2), "
                    f"'pct_of_rows', round(o{i} / {n}L * 100, 2), 'q1', {number(q1)}, 'q3', {number(q3)})")
    return df.select(*[vals[i].alias(f"v{i}") for i in keep]).agg(*counts).selectExpr(f"inline(array({', '.join(rows)}))")


# -------------------------------------------------------------------------- A11
def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every pair i < j of ``cols``."""
    cols = list(cols)
    pairs = [(cols[i], cols[j], i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    meta = df.sparkSession.createDataFrame(pairs, "col_a string, col_b string, pos_a long, pos_b long")
    if not pairs:
        return meta.withColumn("r", F.lit(None).cast("double"))
    r = correlations(df, cols).where("a < b").select(F.col("a").cast("long").alias("pos_a"), F.col("b").cast("long").alias("pos_b"), "r")
    return meta.join(F.broadcast(r), ["pos_a", "pos_b"], "left").select(*meta.columns, "r")  # one row per pair


def corr_top(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` pairs with the largest |r| (pair order on ties)."""
    return (corr_pairs(df, cols).where(F.col("r").isNotNull() & ~F.isnan("r"))
            .orderBy(F.abs("r").desc(), "pos_a", "pos_b").limit(n))


def strongest_corr(df: DataFrame, primary: str, cols: Sequence[str]) -> DataFrame:
    """The column most correlated (by |r|) with ``primary``."""
    others = [c for c in cols if c != primary]
    spark = df.sparkSession
    if not others:
        return spark.createDataFrame([], "column string, r double")
    names = F.array(*[F.lit(c) for c in others])
    r = correlations(df, [primary, *others], firsts=[0]).where((F.col("b") > 0) & F.col("r").isNotNull() & ~F.isnan("r"))
    return r.orderBy(F.abs("r").desc(), "b").limit(1).select(F.element_at(names, F.col("b")).alias("column"), "r")


# -------------------------------------------------------------------------- A21
COPIES_PER_ROW = 100_000  # copies of one point numbered by one task row


def scatter_sample(df: DataFrame, x: str, y: str, key: str | None = None, color: str | None = None,
                   n: int = R.SAMPLE_ROWS, seed: int = R.SAMPLE_SEED, max_colors: int | None = R.MAX_COLORS,
                   file: str | None = None) -> DataFrame:
    """A repeatable uniform sample of ``n`` rows. The colour is kept only
    if the sample has at most ``max_colors`` distinct values (None: always).

    With ``key``, a column that identifies a row, rows are ordered by
    md5(key || seed), without a shuffle. Without, equal points are counted,
    their copies numbered, and every copy is ordered by the md5 of its columns
    (nulls as ``~``), its number and the seed, so repeated, null or plain
    floating-point rows are as likely as any other and need no key. Each task
    keeps its ``n`` best rows (TakeOrderedAndProject).

    ``file``: ``df`` holds rows of Parquet files, filtered or projected but not
    joined, exploded or united, so a row is known by its file (this expression,
    as a rule ``_metadata.file_path``) and its place there: no key, no shuffle."""
    shown = [qcol(x).alias("x"), qcol(y).alias("y")]
    shown.append(qcol(color).cast("string").alias("color") if color else F.lit(None).cast("string").alias("color"))
    if key:
        rows = df.select(qcol(key).alias("key"), *shown,
                         F.md5(F.concat(qcol(key).cast("string"), F.lit(str(seed)))).alias("_h"))
    elif file:
        place = F.concat_ws("|", F.expr(file), F.col("_metadata.row_index").cast("string"), F.lit(str(seed)))
        rows = df.select(*shown, F.md5(place).alias("_h"))
    else:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        last = F.col("_n") - 1
        runs = (df.select(*shown).groupBy("x", "y", "color").agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor(last / COPIES_PER_ROW))))
                .repartition(parts, "x", "y", "color", "_run"))  # copies of a hot point over all tasks
        first = F.col("_run") * COPIES_PER_ROW
        copies = runs.withColumn("_copy", F.explode(F.sequence(first, F.least(first + COPIES_PER_ROW - 1, last))))
        text = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("x", "y", "color")]
        name = F.concat_ws("|", *text, F.col("_copy").cast("string"), F.lit(str(seed)))
        rows = copies.select("x", "y", "color", F.md5(name).alias("_h"))
    s = rows.orderBy(*["_h", *[c for c in ("key", "x", "y", "color") if c in rows.columns]]).limit(n).drop("_h")
    if not color or max_colors is None:
        return s
    # colours in the sample: a window over the n sampled rows only
    from pyspark.sql import Window
    nc = F.size(F.collect_set("color").over(Window.partitionBy()))
    return s.withColumn("color", F.when(nc <= max_colors, F.col("color")))


# --------------------------------------------------------------------------- P7
def describe_numeric(df: DataFrame, c: str, exact: bool = True) -> DataFrame:
    """P7 (numeric): count, missing, min, max, mean, std, median, p25, p75."""
    v = as_double(df, c)
    q = column_quantiles(df, [c], [0.25, 0.5, 0.75], exact=exact).get(c, {})
    return df.agg(F.lit(c).alias("column"), F.count(v).alias("n"),
                  F.count_if(v.isNull()).alias("missing"),
                  (F.count_if(v.isNull()) / F.count(F.lit(1)) * 100).alias("missing_pct"),
                  F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                  F.stddev_samp(v).alias("std"),
                  F.lit(q.get(0.5)).cast("double").alias("median"),
                  F.lit(q.get(0.25)).cast("double").alias("p25"),
                  F.lit(q.get(0.75)).cast("double").alias("p75"))


def describe_date(df: DataFrame, c: str) -> DataFrame:
    """P7 (date): first, last, whole days between, missing."""
    t = as_timestamp(df, c)
    return df.agg(F.lit(c).alias("column"), F.min(t).alias("first"), F.max(t).alias("last"),
                  F.count_if(t.isNull()).alias("missing"),
                  (F.count_if(t.isNull()) / F.count(F.lit(1)) * 100).alias("missing_pct")).select(
        "column", F.date_format("first", "yyyy-MM-dd").alias("first"),
        F.date_format("last", "yyyy-MM-dd").alias("last"),
        F.expr("timestampdiff(DAY, first, last)").cast("long").alias("days"), "missing", "missing_pct")


def describe_categorical(df: DataFrame, c: str, top: int = 5) -> DataFrame:
    """P7 (other): distinct count, missing and the ``top`` most frequent
    values (count desc, value asc), one row per listed value."""
    from tablelens.functions.columns import scalars
    st = scalars(df.agg(F.count_distinct(qcol(c)).alias("nunique"),
                        F.count_if(~present(df, c)).alias("missing"),
                        (F.count_if(~present(df, c)) / F.count(F.lit(1)) * 100).alias("missing_pct")))
    top_df = category_frequency(df, c, top)
    return top_df.select(F.lit(c).alias("column"), F.lit(st["nunique"]).cast("long").alias("nunique"),
                         F.lit(st["missing"]).cast("long").alias("missing"),
                         F.lit(st["missing_pct"]).cast("double").alias("missing_pct"),
                         "rank", F.col("label").alias("value"), "count")

