"""Registered queries: one per catalogue operation, each over the whole
driver tables (or frames Spark derives from them), with the DuckDB SQL that
must return the same rows. ``__spark_entry__`` re-exports both maps.

Result doubles are rounded once at the end (2 dp for money-like values, 6 dp
for ratios) on both sides: summation order differs between engines, and the
inputs carry 2 decimals, so a rounded sum is the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 2, **per_col: int) -> DataFrame:
    """Round every double column (``per_col`` overrides the digits)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), per_col.get(f.name, digits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def as_long(df: DataFrame) -> DataFrame:
    """Integer outputs as bigint, so both engines report one integer type."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name)
                       if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
                       else F.col(f.name) for f in df.schema.fields])


def finish(df: DataFrame, digits: int = 2, **per_col: int) -> DataFrame:
    return as_long(rounded(df, digits, **per_col))


# ---------------------------------------------------------------------------
# Derived inputs (FIXTURES.md section 3): built by Spark from the driver
# tables, and written as the same CTE on the SQL side.

SALES_WIDE_SQL = """
sales_wide as (
  select l_orderkey as order_id, o_orderdate as order_date, r_name as region, n_name as country,
         c_mktsegment as segment, p_brand as product, c_name as customer_name, l_quantity as quantity,
         case when l_linenumber % 7 = 0 then null else l_extendedprice * (1 - l_discount) end as revenue,
         l_extendedprice * (1 - l_discount) * (l_tax + 0.02) as profit,
         concat('$', cast(cast(floor(l_extendedprice) as bigint) as varchar)) as list_price_text
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
       join part on l_partkey = p_partkey)
"""


def sales_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide sales table whose column names trigger every business role;
    ``revenue`` has nulls (every 7th line number) and ``list_price_text`` is
    "$"-text. Star joins: the four dimension tables are small and AQE turns
    those joins into broadcasts at run time; lineitem x orders is the one
    shuffle join and is keyed on the order key."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    p = table(spark, sf_dir, "part")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"),
                    F.col("r_name").alias("region"), F.col("n_name").alias("country"),
                    F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("product"),
                    F.col("c_name").alias("customer_name"), F.col("l_quantity").alias("quantity"),
                    F.when(F.col("l_linenumber") % 7 == 0, F.lit(None)).otherwise(net).alias("revenue"),
                    (net * (F.col("l_tax") + 0.02)).alias("profit"),
                    F.concat(F.lit("$"), F.floor("l_extendedprice").cast("long").cast("string"))
                    .alias("list_price_text")))


def with_sales(sql: str) -> str:
    return "with " + SALES_WIDE_SQL.strip() + ",\n" + sql.strip()


# Import the query groups so their @register calls run.
from tablelens.plans import queries_monthly  # noqa: E402,F401
from tablelens.plans import queries_breakdown  # noqa: E402,F401
from tablelens.plans import queries_distribution  # noqa: E402,F401
from tablelens.plans import queries_quality  # noqa: E402,F401
from tablelens.plans import queries_filters  # noqa: E402,F401
from tablelens.plans import queries_composite  # noqa: E402,F401
