"""Ingest transforms over every column (T1-T5): missing normalisation,
numeric-text and date-text coercion, integer narrowing. Each is one
``select`` (plus, where a decision is needed, one aggregate over all
columns at once)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import FRACTIONAL, INTEGRAL, is_string, qcol

# ---------------------------------------------------------------------------
# Fixed value: the characters stripped before a text value is read as a
# number (same set as the reference).
MONEY_STRIP = r"[,$€£¥%\s]"
# End of fixed values.
# ---------------------------------------------------------------------------

# The number shape accepted after stripping (plain decimal or exponent form;
# an engine's lenient cast would also accept e.g. "5d").
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Date layouts tried, in order, when a text column is named like a date (our
# choice: the reference lets its table library guess the layout).
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "dd.MM.yyyy", "yyyyMMdd",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX",
]


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null in float/double columns, so one test (null)
    means missing everywhere."""
    return df.select(*[F.when(~F.isnan(qcol(f.name)), qcol(f.name)).alias(f.name)
                       if isinstance(f.dataType, FRACTIONAL) else qcol(f.name) for f in df.schema.fields])


def money_clean(c) -> F.Column:
    return F.regexp_replace(c, MONEY_STRIP, "")


def money_value(c) -> F.Column:
    """Number in a text like '$1,200', ' 45% ', '-$5'; blank text is null."""
    cleaned = money_clean(c)
    return F.when(cleaned.rlike(NUMBER_SHAPE), cleaned.try_cast("double"))


def numeric_text_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Text columns whose every non-null value is a number once currency,
    percent, comma and space characters are removed (blank counts as
    missing). One aggregate decides all columns."""
    cols = [c for c in (cols or df.columns) if is_string(df, c)]
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        cleaned = money_clean(qcol(c))
        ok = (cleaned == "") | cleaned.rlike(NUMBER_SHAPE)
        aggs += [F.bool_and(F.when(qcol(c).isNotNull(), ok)).alias(f"ok{i}"),
                 F.count(qcol(c)).alias(f"n{i}")]
    r = df.agg(*aggs).collect()[0]
    return [c for i, c in enumerate(cols) if r[f"n{i}"] > 0 and r[f"ok{i}"]]


def coerce_money(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Replace numeric-looking text columns by doubles; returns the new
    frame and the columns converted."""
    conv = numeric_text_columns(df, cols)
    out = df.select(*[money_value(qcol(c)).alias(c) if c in conv else qcol(c) for c in df.columns])
    return out, conv


# What a layout's fields look like, longest names first; other letters do not occur.
FIELD_SHAPES = {"yyyy": r"\d{4}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "SSSSSS": r"\d{1,6}",
                "XXX": r"(Z|[+-]\d{2}:\d{2})", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}",
                "ss": r"\d{2}", "d": r"\d{1,2}", "'T'": "T"}


def layout_shape(fmt: str) -> str:
    """Pattern of the texts that can have layout ``fmt``."""
    names = "|".join(sorted(FIELD_SHAPES, key=len, reverse=True))
    parts = re.findall(f"({names})|(.)", fmt)
    return "^" + "".join(FIELD_SHAPES[field] if field else re.escape(char) for field, char in parts) + "$"


def detect_date_formats(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """{column: first layout under which every non-null value parses}, for
    the columns that have one. One aggregate decides all columns: a value's
    possible layouts are the bits of a mask, and masks are merged by AND."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = qcol(c).cast("string")
        mask = F.lit(0).cast("long")
        for k, fmt in enumerate(DATE_FORMATS):
            # Parsing sees only texts of the layout's shape: a failed parse is dear.
            fits = F.try_to_timestamp(F.when(v.rlike(layout_shape(fmt)), v), F.lit(fmt)).isNotNull()
            mask = mask + F.when(fits, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        aggs.append(F.bit_and(F.when(v.isNotNull(), mask)).alias(f"m{i}"))
    r = df.agg(*aggs).collect()[0]
    return {c: DATE_FORMATS[(m & -m).bit_length() - 1] for i, c in enumerate(cols) if (m := r[f"m{i}"])}


def detect_date_format(df: DataFrame, col: str) -> str | None:
    """T3 for one column; None if no layout fits all values."""
    return detect_date_formats(df, [col]).get(col)


def date_value(c, fmt: str) -> F.Column:
    """Wall-clock timestamp (no zone) of text in layout ``fmt``; null when it
    does not parse. The ANSI-raising parser only runs on values the try-form
    accepted."""
    return F.when(F.try_to_timestamp(c, F.lit(fmt)).isNotNull(), F.to_timestamp_ntz(c, F.lit(fmt)))


def coerce_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """T4: parse text date columns with their detected layout; values that do
    not parse become null."""
    return df.select(*[date_value(qcol(c), formats[c]).alias(c) if c in formats else qcol(c)
                       for c in df.columns])


_INT_STEPS = [("tinyint", -128, 127), ("smallint", -32768, 32767),
              ("int", -2147483648, 2147483647), ("bigint", -(2 ** 63), 2 ** 63 - 1)]


def narrow_plan(df: DataFrame, floats: bool = False) -> DataFrame:
    """T5: (column, from_type, to_type): the smallest integer type that holds
    each integer column's min..max (one aggregate for all columns); doubles
    go to float only when ``floats``."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL)]
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    spark = df.sparkSession
    if not ints and not (floats and dbl):
        return spark.createDataFrame([], "column string, from_type string, to_type string")
    aggs = [F.lit(0).alias("_z")]
    for i, c in enumerate(ints):
        aggs += [F.min(qcol(c)).cast("long").alias(f"lo{i}"), F.max(qcol(c)).cast("long").alias(f"hi{i}")]
    row = df.agg(*aggs)
    specs = []
    for i, c in enumerate(ints):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        to = F.lit(df.schema[c].dataType.simpleString())
        for name, a, b in reversed(_INT_STEPS):
            to = F.when(lo.isNotNull() & (lo >= a) & (hi <= b), F.lit(name)).otherwise(to)
        specs.append(F.struct(F.lit(c).alias("column"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("from_type"),
                              to.alias("to_type")))
    if floats:
        specs += [F.struct(F.lit(c).alias("column"), F.lit("double").alias("from_type"),
                           F.lit("float").alias("to_type")) for c in dbl]
    return row.select(F.explode(F.array(*specs)).alias("r")).select("r.*")


def narrow_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Apply ``narrow_plan``: cast each column to its narrowed type."""
    plan = {r["column"]: r["to_type"] for r in narrow_plan(df, floats).collect()}
    return df.select(*[qcol(c).cast(plan[c]).alias(c) if c in plan else qcol(c) for c in df.columns])
