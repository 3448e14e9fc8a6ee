"""Sources and sinks (IO1-IO5): CSV read with pandas-like type and NA
inference, Parquet read, empty-table guard, CSV/Parquet write, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions import rules as R
from tablelens.functions.columns import is_supported, is_temporal, qcol
from tablelens.sources.csv_records import read_lines, read_records

# ---------------------------------------------------------------------------
# Text read as missing in a CSV cell (the default NA words of
# the CSV reader the reference relies on).
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# End of fixed values.
# ---------------------------------------------------------------------------
INT_SHAPE = r"^[+-]?\d+$"
FLOAT_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Infinity)$"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Quoted line breaks, doubled quotes; the rest as Spark reads a CSV.
CSV_OPTIONS = {"multiLine": "true", "escape": '"'}


def _one_task_per_file(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding)
            .options(**CSV_OPTIONS).csv(path))


#: A file from this size on is read in byte ranges: finding the records costs some
#: 20 times the work of parsing, so it pays only with hundreds of tasks.
RANGED_BYTES = 32 << 30


def read_csv(spark: SparkSession, path: str, ranged: bool | None = None) -> DataFrame:
    """IO1/T1b: header CSV with quoted line breaks and doubled quotes. Read as
    UTF-8, or as Latin-1 if a line is not valid UTF-8; then ``infer_types``. A file
    is one task, or, if one has ``RANGED_BYTES`` (``ranged``: always or never), all
    are read in byte ranges side by side (``csv_records``); files whose only line
    ends are lone carriage returns are one task each. Every job parses the text
    again: for more than one, use ``csv_to_parquet``."""
    lines = read_lines(spark, path)
    seen = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.is_valid_utf8("line")).alias("bad"),
                     F.count_if(F.regexp_like("line", F.lit(r"\r[^\n]"))).alias("returns")).first()
    latin = bool(seen["bad"])
    plain = _one_task_per_file(spark, path, "ISO-8859-1" if latin else "UTF-8")
    if ranged is None:
        largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
        ranged = (largest or 0) >= RANGED_BYTES
    if not ranged or not plain.columns or (seen["returns"] and seen["n"] <= len(plain.inputFiles())):
        return infer_types(plain)
    return infer_types(read_records(spark, path, plain.columns, CSV_OPTIONS, latin))


def csv_to_parquet(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Parse a CSV once into Parquet at ``target`` (a shared folder) and read that."""
    write_parquet(read_csv(spark, path), target)
    return read_parquet(spark, target)


def infer_types(text: DataFrame) -> DataFrame:
    """Types of a frame of text columns. Cells that are an NA word as they
    stand (padded ones and blanks are text) become null; a column
    becomes bigint (decimal(38,0) if a value needs it), double or boolean only
    if every non-missing value has that shape (one aggregate decides all
    columns), else it keeps its text as it stands, blanks included."""
    if not text.columns:
        return text
    cleaned = text.select(*[F.when(~qcol(c).isin(NA_WORDS), qcol(c)).alias(c) for c in text.columns])
    aggs = []
    for i, c in enumerate(cleaned.columns):
        v = F.trim(qcol(c))
        whole = F.when(v.rlike(INT_SHAPE), v)  # the casts see nothing else: a failed cast is dear
        shapes = {"i": whole.isNotNull(), "l": whole.try_cast("long").isNotNull(),
                  "d": whole.try_cast("decimal(38,0)").isNotNull(), "f": v.rlike(FLOAT_SHAPE),
                  "b": F.lower(v).isin("true", "false")}
        aggs += [F.count(v).alias(f"n{i}"),
                 *[F.bool_and(F.when(v.isNotNull(), ok)).alias(f"{k}{i}") for k, ok in shapes.items()]]
    r = cleaned.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cleaned.columns):
        v = F.trim(qcol(c))
        if r[f"n{i}"] == 0:
            typed = v.cast("double")  # all-missing column reads as float
        elif r[f"i{i}"] and r[f"l{i}"]:
            typed = v.try_cast("long")
        elif r[f"i{i}"] and r[f"d{i}"]:
            typed = v.try_cast("decimal(38,0)")
        elif r[f"f{i}"] and not r[f"i{i}"]:
            typed = v.try_cast("double")
        elif r[f"b{i}"]:
            typed = F.lower(v) == "true"
        else:
            typed = qcol(c)
        out.append(typed.alias(c))
    return cleaned.select(*out)


def is_empty(df: DataFrame) -> bool:
    """IO2: stop before any analytics when the table has no rows."""
    return df.isEmpty()


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO3: header CSV, one file per task (no single-writer bottleneck)."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def preview(df: DataFrame, n: int = R.PREVIEW_ROWS) -> DataFrame:
    """IO5: first ``n`` rows in the order of all columns (nulls first), dates
    as text. Each task keeps its ``n`` best rows (TakeOrderedAndProject)."""
    cols = [c for c in df.columns if is_supported(df, c)]
    out = df.select(*[qcol(c).cast("string").alias(c) if is_temporal(df, c) else qcol(c) for c in cols])
    return out.orderBy(*[qcol(c).asc_nulls_first() for c in cols]).limit(n)
