"""Column-level helpers shared by every operator: type tests, null-safe
casts and ratios. All are plain Spark expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def qcol(name: str) -> Column:
    """Column reference by its literal name: user columns may hold dots,
    spaces or backticks, which a plain ``F.col`` would parse."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(dtype(df, c), NUMERIC)


def is_temporal(df: DataFrame, c: str) -> bool:
    return isinstance(dtype(df, c), TEMPORAL)


def is_string(df: DataFrame, c: str) -> bool:
    return isinstance(dtype(df, c), T.StringType)


def is_boolean(df: DataFrame, c: str) -> bool:
    return isinstance(dtype(df, c), T.BooleanType)


def is_supported(df: DataFrame, c: str) -> bool:
    return not isinstance(dtype(df, c), NESTED)


def present(df: DataFrame, c: str) -> Column:
    """True where the value is not missing; NaN counts as missing."""
    col = qcol(c)
    if isinstance(dtype(df, c), FRACTIONAL):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def as_double(df: DataFrame, c: str) -> Column:
    """Numeric view of a column as double, NaN and unparseable text as null."""
    col = qcol(c)
    dt = dtype(df, c)
    if isinstance(dt, FRACTIONAL):
        return F.when(~F.isnan(col), col.cast("double"))
    if isinstance(dt, NUMERIC):
        return col.cast("double")
    if isinstance(dt, T.BooleanType):
        return col.cast("int").cast("double")
    return col.try_cast("double")


def as_date(df: DataFrame, c: str) -> Column:
    """Calendar date of a date/timestamp column (text is tried as a date).
    NTZ timestamps are cast straight to date, never through the session
    zone, so month bins do not shift."""
    col = qcol(c)
    if isinstance(dtype(df, c), TEMPORAL):
        return col.cast("date")
    return col.try_cast("timestamp_ntz").cast("date")


def as_timestamp(df: DataFrame, c: str) -> Column:
    col = qcol(c)
    dt = dtype(df, c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return col
    if isinstance(dt, T.DateType):
        return col.cast("timestamp_ntz")
    return col.try_cast("timestamp_ntz")


def scalars(one_row: DataFrame) -> dict:
    """Values of a one-row result (an aggregate without grouping) as a dict,
    for use as literals in later plans; {} if it has no row."""
    r = one_row.limit(1).collect()
    return r[0].asDict(recursive=True) if r else {}


def sql_literal(v) -> str:
    """A Python value as a Spark SQL literal (text quoted and escaped)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct_array_sql(rows: list[dict]) -> str:
    """``array(named_struct(...), ...)`` of literal rows, as one SQL string:
    a lookup table inside an expression, built with a single call instead of
    one call per value."""
    return "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in r.items()) + ")" for r in rows) + ")"


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few driver rows as a local relation: reading them starts no job, unlike
    rows that ``createDataFrame`` distributes."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    columns = list(zip(*rows)) or [()] * len(schema)
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), schema)
