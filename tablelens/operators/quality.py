"""Data quality: missing cells, duplicate rows, per-column distinct counts,
health score, metadata and the summary sheet (A9, A12-A14, D1, D2, IO4).

Duplicates are found without shuffling every whole row: rows are first
grouped by a 64-bit hash of all columns (8 bytes per row cross the network);
only rows whose hash occurs more than once are then grouped by their full
values, which also settles hash collisions exactly. Nulls compare equal, as
in a whole-row duplicate test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import rules as R
from tablelens.functions.columns import INTEGRAL, NUMERIC, is_supported, present, qcol


def supported_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_supported(df, c)]


def _struct_rows(row_df: DataFrame, specs: list) -> DataFrame:
    """Turn one wide aggregate row into rows via explode(array(struct))."""
    return row_df.select(F.explode(F.array(*specs)).alias("r")).select("r.*")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, position, rows, missing) for every column, one scan."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(~present(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    return _struct_rows(row, [F.struct(F.lit(c).alias("column"), F.lit(i).cast("long").alias("position"),
                                       F.col("_rows").alias("rows"), F.col(f"m{i}").alias("missing"))
                              for i, c in enumerate(cols)])


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent of rows (2 dp)."""
    return (null_counts(df).where(F.col("missing") > 0)
            .select("column", "missing", F.round(F.col("missing") / F.col("rows") * 100, 2).alias("pct")))


def duplicate_groups(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct rows that occur more than once, with their count ``_n``."""
    cols = cols or supported_columns(df)
    h = F.xxhash64(*[qcol(c) for c in cols])
    # Only rows whose hash repeats are grouped by value; the join strategy is
    # left to AQE, which broadcasts the hashes where they measure small.
    repeated = df.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select("_h")
    rows = df.select(*[qcol(c) for c in cols]).join(repeated, h == F.col("_h"), "left_semi")
    return rows.groupBy(*[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)


def duplicate_count(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row (all copies but one per group)."""
    g = duplicate_groups(df, cols)
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("dup_rows"))


def duplicate_rows(df: DataFrame, limit: int = R.DUPLICATE_LISTING, cols: list[str] | None = None) -> DataFrame:
    """Every copy of every duplicated row, first ``limit`` in the order of
    all columns (ascending, nulls first). Only ``limit`` groups are expanded,
    and each by at most ``limit`` copies."""
    cols = cols or supported_columns(df)
    g = duplicate_groups(df, cols).orderBy(*[qcol(c) for c in cols]).limit(limit)
    copies = F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(limit)).cast("int"))
    return (g.select(*[qcol(c) for c in cols], F.explode(copies).alias("_i")).orderBy(*[qcol(c) for c in cols]).limit(limit).drop("_i"))


def _family_value(df: DataFrame, c: str) -> tuple[str, F.Column]:
    """(family, value) of a column for distinct counting: integers, dates and
    timestamps as bigint (timestamps as microseconds by wall-clock
    arithmetic, no zone), other numbers as double (Spark normalises -0.0 and
    NaN in grouping keys), everything else as text. No number is formatted
    as text. Missing values (NaN too) are null."""
    dt = df.schema[c].dataType
    v = qcol(c)
    if isinstance(dt, INTEGRAL + (T.BooleanType,)):
        out = ("l", v.cast("long"))
    elif isinstance(dt, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        out = ("l", F.timestamp_diff("MICROSECOND", epoch, v))
    elif isinstance(dt, T.TimestampType):
        out = ("l", F.unix_micros(v))
    elif isinstance(dt, T.DateType):
        out = ("l", F.unix_date(v).cast("long"))
    elif isinstance(dt, NUMERIC):
        out = ("d", v.cast("double"))
    else:
        out = ("s", v.cast("string"))
    return out[0], F.when(present(df, c), out[1])


# The characters of text numbers with their marks, and the length above which
# other text is compared by its digest (65 characters).
NUMBER_CHARS = r"^[0-9eE.+,$€£¥%\s-]*$"
DIGEST_CHARS = 64


def column_stats(df: DataFrame, meta: dict[str, dict] | None = None, approx: bool = False,
                 rsd: float = 0.02) -> DataFrame:
    """One job for every supported column: (column, position, <meta fields>,
    rows, n, nunique, numeric_text, lo, hi); lo/hi are the numeric bounds
    (null for text; timestamps as microseconds).

    One job, with one scan for each kind of value there is (integers; other numbers;
    text), which reads the columns of that kind only: they are unpivoted (an Expand)
    into narrow rows (column number, value), repeats are dropped on the map side, one
    shuffle brings equal values together and a second, small aggregate counts them
    per column. Streams of one kind keep the aggregate's keys fixed in width and take
    about half the time of one stream with a field for each kind. Integers, dates,
    timestamps and booleans go as bitmaps: a value is a bit in the 64-bit word of its 64
    neighbours, words are merged by OR in every task, so a dense column sends one
    word instead of up to 64 values and a sparse one no more than its values; the
    set bits are the distinct count. (Plain hash aggregation: the 4 KB bitmaps of
    Spark's own functions would sort every row and be ruinous on sparse columns.) A text longer than
    ``DIGEST_CHARS`` that cannot be a number stands in as its 256-bit SHA-2, so
    no long text is shuffled. Per-column metadata (``meta``: name ->
    {field: literal}) is attached by position from a literal array (no join).
    ``numeric_text``: every non-missing text value is a number once currency,
    percent and separator characters are removed (blank counts as missing).
    ``approx=True``: HyperLogLog sketches instead of exact distinct counts."""
    cols = df.columns  # positions count every column; only supported ones are read
    meta = meta or {}
    fields = sorted({f for m in meta.values() for f in m})
    kinds: dict[str, list[tuple[int, F.Column]]] = {}
    for i, c in enumerate(cols):
        if is_supported(df, c):
            family, v = _family_value(df, c)
            kinds.setdefault(family, []).append((i, v))
    if not kinds:
        return df.sparkSession.createDataFrame(
            [], "column string, position long, " + "".join(f"{f} string, " for f in fields)
            + "rows long, n long, nunique long, numeric_text boolean, lo double, hi double")
    g = reduce(DataFrame.unionByName, [_kind_stats(df, f, values, approx, rsd) for f, values in kinds.items()])
    # Column name and metadata by position: a literal array lookup, no join.
    from tablelens.functions.columns import struct_array_sql
    table = struct_array_sql([{"column": c, **{f: meta.get(c, {}).get(f) for f in fields}} for c in cols])
    info = F.expr(f"element_at({table}, k + 1)")
    return g.select(info.alias("info"), F.col("k").cast("long").alias("position"), "rows", "n", "nunique",
                    ((F.col("n") > 0) & F.coalesce("text_ok", F.lit(False))).alias("numeric_text"), "lo", "hi").select(
        "info.column", "position", *[f"info.{f}" for f in fields], "rows", "n", "nunique", "numeric_text", "lo", "hi")


def _kind_stats(df: DataFrame, family: str, values: list[tuple[int, F.Column]], approx: bool, rsd: float) -> DataFrame:
    """(k, rows, n, nunique, text_ok, lo, hi) of the columns of one kind; ``values``:
    their positions and values."""
    from tablelens.operators.ingest import MONEY_STRIP, NUMBER_SHAPE
    bitmap, wide = family == "l" and not approx, []
    for i, v in values:
        if family == "s":
            long_text = (F.length(v) > DIGEST_CHARS) & ~v.rlike(NUMBER_CHARS)
            v = F.when(long_text, F.concat(F.lit("#"), F.sha2(v, 256))).otherwise(v)
        if bitmap:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(63).cast("int"))
            wide.append(bit.alias(f"b{i}"))
            v = F.shiftright(v, 6)
        wide.append(v.alias(f"v{i}"))
    names, item = ("(v, b)", "(v{0}, b{0})") if bitmap else ("v", "v{0}")
    keys = ", ".join(f"{item.format(i)} AS `{i}`" for i, _ in values)
    rows = df.sparkSession.sql(
        f"SELECT CAST(k AS INT) AS k, * EXCEPT (k) FROM {{wide}} UNPIVOT INCLUDE NULLS ({names} FOR k IN ({keys}))",
        wide=df.select(*wide))
    # The first letter ends the first test: no text is rewritten unless it may be a number.
    cleaned = F.regexp_replace("v", MONEY_STRIP, "")
    number = F.col("v").rlike(NUMBER_CHARS) & ((cleaned == "") | cleaned.rlike(NUMBER_SHAPE))
    text_ok = (F.bool_and(number) if family == "s" else F.max(F.lit(None).cast("boolean"))).alias("text_ok")
    low = high = F.lit(None).cast("double") if family == "s" else F.col("v").cast("double")
    if approx:
        count, there, distinct = F.count(F.lit(1)), F.count("v"), F.approx_count_distinct("v", rsd)
    else:
        rows = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"), *([F.bit_or("b").alias("b")] if bitmap else []))
        count, there = F.sum("c"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0))
        distinct = F.coalesce(F.sum(F.bit_count("b")), F.lit(0)).cast("long") if bitmap else F.count("v")
    if bitmap:
        low = F.expr("cast(shiftleft(v, 6) | (length(bin(b)) - length(trim(TRAILING '0' FROM bin(b)))) as double)")
        high = F.expr("cast(shiftleft(v, 6) | (length(bin(b)) - 1) as double)")
    return rows.groupBy("k").agg(count.alias("rows"), there.alias("n"), distinct.alias("nunique"), text_ok,
                                 F.min(low).alias("lo"), F.max(high).alias("hi"))


def distinct_counts(df: DataFrame, approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """(column, position, rows, n, nunique) for every supported column."""
    return column_stats(df, approx=approx, rsd=rsd).select("column", "position", "rows", "n", "nunique")


def uniqueness(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct values per column and as a percent of all rows."""
    d = distinct_counts(df, approx)
    return d.select("column", "nunique",
                    (F.col("nunique") / F.greatest(F.col("rows"), F.lit(1)) * 100).alias("uniqueness_pct"))


def _has_type(df: DataFrame, kinds) -> bool:
    return any(isinstance(f.dataType, kinds) and not isinstance(f.dataType, T.BooleanType)
               for f in df.schema.fields)


def health(df: DataFrame, dup_rows: int | None = None) -> DataFrame:
    """Health score 0-100 and grade from completeness (40), uniqueness
    (30), type diversity (15) and size (15), with the missing and duplicate
    figures behind it. One row."""
    ncols = len(df.columns)
    if dup_rows is None:
        dup_rows = duplicate_count(df).collect()[0]["dup_rows"]
    has_num = _has_type(df, NUMERIC)
    has_str = _has_type(df, (T.StringType,))
    diversity = min(R.HEALTH_DIVERSITY_MAX, R.HEALTH_DIVERSITY_STEP * (
        int(has_num) + int(has_str) + int(ncols >= R.HEALTH_DIVERSITY_MIN_COLUMNS)))
    a = df.agg(F.count(F.lit(1)).alias("rows"),
               sum((F.count_if(~present(df, c)) for c in df.columns), F.lit(0)).alias("missing_cells"))
    rows, miss = F.col("rows"), F.col("missing_cells")
    total = rows * ncols
    miss_pct = miss / (total + R.EPSILON)
    dup = F.lit(int(dup_rows)).cast("long")
    dup_pct = dup / (rows + R.EPSILON)
    completeness = F.greatest(F.lit(0.0), R.HEALTH_COMPLETENESS * (1 - miss_pct * R.HEALTH_MISSING_FACTOR))
    uniq = F.greatest(F.lit(0.0), R.HEALTH_UNIQUENESS * (1 - dup_pct * R.HEALTH_DUPLICATE_FACTOR))
    row_score = F.when(rows > 0, F.least(F.lit(float(R.HEALTH_SIZE)), R.HEALTH_SIZE * F.least(
        rows / R.HEALTH_SIZE_ROWS, F.lit(1.0)))).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), completeness + uniq + F.lit(float(diversity))
                                           + row_score)).cast("long")
    out = a.select(score.alias("score"), rows.alias("rows"), F.lit(ncols).cast("long").alias("columns"),
                   total.cast("long").alias("total_cells"), miss.cast("long").alias("missing_cells"),
                   F.round(miss_pct * 100, 2).alias("missing_pct"), dup.alias("dup_rows"),
                   F.round(dup_pct * 100, 2).alias("dup_pct"))
    s = F.col("score")
    grade = F.lit("F")
    for cut, g in reversed(R.GRADES):
        grade = F.when(s >= cut, g).otherwise(grade)
    return out.withColumn("grade", grade)


def export_summary(health_df: DataFrame) -> DataFrame:
    """IO4: the summary sheet rows (Metric, Value) from a health row."""
    h = health_df
    return _struct_rows(h, [F.struct(F.lit(m).alias("metric"), qcol(c).cast("long").alias("value"))
                            for m, c in [("Rows", "rows"), ("Columns", "columns"),
                                         ("Missing Cells", "missing_cells"),
                                         ("Duplicate Rows", "dup_rows"), ("Health Score", "score")]])


def metadata(health_df: DataFrame, role_counts: dict[str, int]) -> DataFrame:
    """(metric, value) dataset facts from the health row and the role
    counts of the profile."""
    h = health_df
    specs = [("Rows", F.col("rows")), ("Columns", F.col("columns")),
             ("Numeric Cols", F.lit(role_counts.get("numeric", 0))),
             ("Categorical Cols", F.lit(role_counts.get("categorical", 0))),
             ("Date Cols", F.lit(role_counts.get("date", 0))), ("Health Score", F.col("score")),
             ("Missing Cells", F.col("missing_cells")), ("Missing %", F.col("missing_pct")),
             ("Duplicate Rows", F.col("dup_rows")), ("Duplicate %", F.col("dup_pct")),
             ("Unique Rows", F.col("rows") - F.col("dup_rows"))]
    return _struct_rows(h, [F.struct(F.lit(m).alias("metric"), e.cast("double").alias("value")) for m, e in specs])
