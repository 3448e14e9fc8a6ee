"""Registered queries: data quality, profiling and ingest (A9, A12-A14, D1,
D2, IO4, P1, P4, P6, P8, T2, T4, T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions import names as N
from tablelens.functions.columns import FRACTIONAL
from tablelens.operators import ingest as I
from tablelens.operators import quality as Q
from tablelens.plans import profile as P
from tablelens.plans.catalog import SALES_WIDE_SQL, finish, register, sales_wide, table, with_sales

DUP_COLS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]


def dup_lines(spark, sf):
    return table(spark, sf, "lineitem").select(*DUP_COLS)


def null_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*[F.expr(f"nullif({c}, 0)").alias(c) if c in ("l_discount", "l_tax") else F.col(c)
                       for c in li.columns])


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NULL_LINES_SQL = ("null_lines as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
                  "l_extendedprice, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax, "
                  "l_returnflag, l_linestatus, l_shipdate from lineitem)")
DUP_SQL = "dup_lines as (select l_returnflag, l_linestatus, l_quantity, l_discount from lineitem)"


@register("duplicate_count", f"""
with {DUP_SQL}
select cast(coalesce(sum(c - 1), 0) as bigint) as dup_rows
from (select count(*) as c from dup_lines group by l_returnflag, l_linestatus, l_quantity, l_discount
      having count(*) > 1)""")
def duplicate_count(spark, sf):
    return finish(Q.duplicate_count(dup_lines(spark, sf)))


@register("duplicate_rows", f"""
with {DUP_SQL},
d as (select *, count(*) over (partition by l_returnflag, l_linestatus, l_quantity, l_discount) as c
      from dup_lines)
select l_returnflag, l_linestatus, l_quantity, l_discount from d where c > 1
order by l_returnflag nulls first, l_linestatus nulls first, l_quantity nulls first, l_discount nulls first
limit 50""")
def duplicate_rows(spark, sf):
    return finish(Q.duplicate_rows(dup_lines(spark, sf), 50), 4)


@register("missing_by_column", f"""
with {NULL_LINES_SQL},
m as (""" + "\nunion all\n".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as missing, count(*) as rows "
    f"from null_lines" for c in LINEITEM_COLS) + """)
select "column", missing, round(missing / rows * 100, 2) as pct from m where missing > 0""")
def missing_by_column(spark, sf):
    return finish(Q.missing_by_column(null_lines(spark, sf)))


@register("uniqueness", "\nunion all\n".join(
    f"select '{c}' as \"column\", count(distinct {c}) as nunique, "
    f"round(count(distinct {c}) / greatest(count(*), 1) * 100, 6) as uniqueness_pct from lineitem"
    for c in LINEITEM_COLS))
def uniqueness(spark, sf):
    return finish(Q.uniqueness(table(spark, sf, "lineitem")), 6)


def _health_sql(src_cte: str, src: str, cols: list[str], diversity: int) -> str:
    ncols = len(cols)
    miss = " + ".join(f"count(*) filter (where {c} is null)" for c in cols)
    colist = ", ".join(cols)
    return f"""
with {src_cte},
d as (select cast(coalesce(sum(c - 1), 0) as bigint) as dup_rows
      from (select count(*) as c from {src} group by {colist} having count(*) > 1)),
a as (select count(*) as rows, {miss} as missing_cells from {src}),
x as (select rows, missing_cells, dup_rows, missing_cells / (rows * {ncols} + 1e-9) as mp,
             dup_rows / (rows + 1e-9) as dp from a, d),
s as (select *, cast(trunc(greatest(0.0, least(100.0,
          greatest(0.0, 40 * (1 - mp * 2)) + greatest(0.0, 30 * (1 - dp * 3)) + {float(diversity)}
          + case when rows > 0 then least(15.0, 15 * least(rows / 500, 1.0)) else 0.0 end))) as bigint) as score
      from x)
select score, rows, cast({ncols} as bigint) as columns, cast(rows * {ncols} as bigint) as total_cells,
       cast(missing_cells as bigint) as missing_cells, round(mp * 100, 2) as missing_pct, dup_rows,
       round(dp * 100, 2) as dup_pct,
       case when score >= 85 then 'A' when score >= 70 then 'B' when score >= 55 then 'C'
            when score >= 40 then 'D' else 'F' end as grade
from s"""


@register("health", _health_sql(NULL_LINES_SQL, "null_lines", LINEITEM_COLS, 15))
def health(spark, sf):
    return finish(Q.health(null_lines(spark, sf)))


@register("health_dups", _health_sql(DUP_SQL, "dup_lines", DUP_COLS, 15))
def health_dups(spark, sf):
    return finish(Q.health(dup_lines(spark, sf)))


@register("export_summary", _health_sql(NULL_LINES_SQL, "null_lines", LINEITEM_COLS, 15).replace(
    "select score, rows,", "select * from (select score, rows, columns, missing_cells, dup_rows from (select score, rows,", 1)
    + """))
unpivot (value for metric in (rows as 'Rows', columns as 'Columns', missing_cells as 'Missing Cells',
                              dup_rows as 'Duplicate Rows', score as 'Health Score'))""")
def export_summary(spark, sf):
    return finish(Q.export_summary(Q.health(null_lines(spark, sf))))


# ----------------------------------------------------------------- profiling
def _kind(dt) -> str:
    from pyspark.sql import types as T
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                       T.DecimalType)):
        return "numeric"
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return "unsupported"
    return "string"


NUM_TEXT_SQL = ("(regexp_replace({c}, '[,$€£¥%\\s]', '', 'g') = '' or regexp_full_match("
                "regexp_replace({c}, '[,$€£¥%\\s]', '', 'g'), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?'))")


def has_word(name: str, keywords) -> str:
    """SQL: whether a whole word of a column name is one of ``keywords``."""
    words = (f"string_split_regex(lower(regexp_replace('{name}', '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')")
    return f"list_has_any({words}, [{', '.join(repr(k) for k in keywords)}])"


def keyword_rank(name: str, keywords) -> str:
    """SQL: number of the first keyword that is a word of the name, else null."""
    whens = " ".join(f"when {has_word(name, [k])} then {i}" for i, k in enumerate(keywords))
    return f"cast(case {whens} end as int)" if whens else "cast(null as int)"


def roles_cte(src: str, fields) -> str:
    """SQL for (column, position, n, nuniq, role): counts, text tests and name
    words are computed by SQL."""
    parts = []
    for i, (c, dt) in enumerate(fields):
        kind = _kind(dt)
        idn = has_word(c, N.ID_HINTS)
        if kind == "unsupported":
            parts.append(f"select '{c}' as \"column\", cast({i} as bigint) as position, cast(0 as bigint) as n, "
                         f"cast(0 as bigint) as nuniq, 'unsupported' as role")
            continue
        v = f"case when isnan({c}) then null else {c} end" if isinstance(dt, FRACTIONAL) else c
        numtext = (f"(count({c}) > 0 and coalesce(bool_and(case when {c} is not null then "
                   f"{NUM_TEXT_SQL.format(c=c)} end), false))" if kind == "string" else "false")
        n, u = "count(v)", "count(distinct v)"
        role = f"""case when {n} = 0 then null
            when '{kind}' = 'temporal' then 'date'
            when '{kind}' = 'boolean' then 'boolean'
            when '{kind}' = 'numeric' and {u} <= 2 then 'boolean'
            when '{kind}' = 'numeric' and {idn} and {u} > 0.8 * {n} then 'id'
            when '{kind}' = 'numeric' then 'numeric'
            when {numtext} then 'numeric'
            when {idn} and {u} > 0.5 * {n} then 'id'
            when {u} <= {N.CAT_UNIQUE_LIMIT} or {u} / greatest({n}, 1) < 0.15 then 'categorical'
            else 'id' end"""
        parts.append(f"select '{c}' as \"column\", cast({i} as bigint) as position, {n} as n, {u} as nuniq, "
                     f"{role} as role from (select {v} as v, {c} from {src})")
    return "roles as (" + "\nunion all\n".join(parts) + ")"


# Schemas of the driver tables (TESTDATA.md / FIXTURES.md §1), used only to
# write the SQL side; stated here so that importing the catalogue reads no file.
_DRIVER_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def _schema_of(name):
    from pyspark.sql import types as T
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
             "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType())}
    out = []
    for part in _DRIVER_SCHEMAS[name].split(", "):
        col, typ = part.split(" ", 1)
        out.append((col, kinds[typ]))
    return out


def _sales_fields():
    from pyspark.sql import types as T
    return [("order_id", T.LongType()), ("order_date", T.TimestampNTZType()), ("region", T.StringType()),
            ("country", T.StringType()), ("segment", T.StringType()), ("product", T.StringType()),
            ("customer_name", T.StringType()), ("quantity", T.DoubleType()), ("revenue", T.DoubleType()),
            ("profit", T.DoubleType()), ("list_price_text", T.StringType())]


for _t in ["orders", "lineitem", "customer", "part", "events", "documents", "labels", "conversations",
           "embeddings"]:
    def _mk(t):
        def fn(spark, sf):
            return finish(P.column_roles(table(spark, sf, t)))
        return fn
    register(f"column_roles_{_t}", "with " + roles_cte(_t, _schema_of(_t)) + "\nselect * from roles")(_mk(_t))


@register("column_roles_sales", with_sales(roles_cte("sales_wide", _sales_fields()) + "\nselect * from roles"))
def column_roles_sales(spark, sf):
    return finish(P.column_roles(sales_wide(spark, sf)))


def _primary_ctes(src: str, fields) -> str:
    """Column sums, and keyword ranks of the names: ``kw`` by the general list,
    ``t0``, ``t1``, ... by each template's."""
    sums, ranks = [], []
    for c, dt in fields:
        kind = _kind(dt)
        if kind == "numeric":
            sums.append(f"select '{c}' as \"column\", cast(sum({c}) as double) as s from {src}")
        elif kind == "string":
            sums.append(f"select '{c}' as \"column\", sum(try_cast(regexp_replace({c}, '[,$€£¥%\\s]', '', 'g') "
                        f"as double)) as s from {src}")
        by_template = "".join(f", {keyword_rank(c, k)} as t{i}" for i, k in enumerate(N.TEMPLATE_HINTS.values()))
        ranks.append(f"select '{c}' as \"column\", {keyword_rank(c, N.PRIMARY_MEASURE_PRIORITY)} as kw{by_template}")
    return (roles_cte(src, fields) + ",\nsums as (" + "\nunion all\n".join(sums) + "),\nkw as ("
            + "\nunion all\n".join(ranks) + ")")


def _primary_pick(template: str = "null") -> str:
    """Template rank first, then keyword rank, then largest sum, then position."""
    return f"""select "column", case when {template} is not null then 'template' when kw is not null then 'keyword'
  else 'largest_sum' end as method
from roles join kw using ("column") left join sums using ("column") where role = 'numeric'
order by {template} asc nulls last, kw asc nulls last, case when kw is null then s end desc nulls last, position limit 1"""


def _primary_sql(src: str, fields, prefix: str = "with ") -> str:
    return prefix + _primary_ctes(src, fields) + "\n" + _primary_pick("cast(null as int)")


def _primary_fn(src_fn):
    def fn(spark, sf):
        df = src_fn(spark, sf)
        prof = P.build_profile(df)
        col, method = P.pick_primary_measure(df, prof.schema["numeric"])
        return spark.createDataFrame([(col, method)], "column string, method string")
    return fn


register("primary_measure_lineitem", _primary_sql("lineitem", _schema_of("lineitem")))(
    _primary_fn(lambda s, sf: table(s, sf, "lineitem")))
register("primary_measure_customer", _primary_sql("customer", _schema_of("customer")))(
    _primary_fn(lambda s, sf: table(s, sf, "customer")))
register("primary_measure_part", _primary_sql("part", _schema_of("part")))(
    _primary_fn(lambda s, sf: table(s, sf, "part")))
register("primary_measure_sales", _primary_sql("sales_wide", _sales_fields(),
                                               prefix="with " + SALES_WIDE_SQL.strip() + ",\n"))(
    _primary_fn(sales_wide))



@register("primary_templates_sales", "with " + SALES_WIDE_SQL.strip() + ",\n" + _primary_ctes("sales_wide", _sales_fields())
          + "\n" + "\nunion all\n".join(f"select '{t}' as template, * from ({_primary_pick(f't{i}')})"
                                         for i, t in enumerate(N.TEMPLATE_HINTS)))
def primary_templates_sales(spark, sf):
    """P5: the primary measure under each template."""
    df = sales_wide(spark, sf)
    numeric = P.build_profile(df).schema["numeric"]
    picks = [(t, *P.pick_primary_measure(df, numeric, t)) for t in N.TEMPLATE_HINTS]
    return spark.createDataFrame(picks, "template string, column string, method string")


_DTYPE = {"orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]}


@register("profile_columns", "with " + roles_cte("orders", _schema_of("orders")) + ",\nm as ("
          + "\nunion all\n".join(
              f"select '{c}' as \"column\", '{_DTYPE['orders'][i]}' as dtype, "
              f"round(count(*) filter (where {c} is null) / count(*) * 100, 2) as missing_pct from orders"
              for i, (c, _) in enumerate(_schema_of("orders"))) + """)
select "column", position, dtype, role, missing_pct from roles join m using ("column")""")
def profile_columns(spark, sf):
    return finish(P.profile_columns(table(spark, sf, "orders")))


def _semantic_cte(fields) -> str:
    """(semantic_role, column) for every name that has a keyword of the role."""
    return "m as (" + "\nunion all\n".join(
        f"select '{role}' as semantic_role, '{c}' as \"column\" where {has_word(c, kws)}"
        for c, _ in fields for role, kws in N.SEMANTIC_ROLE_HINTS.items()) + ")"


_ROLE_ORDER = "case role when 'numeric' then 0 when 'categorical' then 1 when 'date' then 2 when 'id' then 3 else 4 end"


def _profile_json_sql(src: str, dtypes: list[str]) -> str:
    fields = _schema_of(src)
    columns = "\nunion all\n".join(
        f"""select 'dtype', {i}, '{c}', '{t}' union all
select 'missing_pct', {i}, '{c}', cast(round(count(*) filter (where {c} is null) / count(*) * 100, 2) as varchar) from {src}"""
        for i, ((c, _), t) in enumerate(zip(fields, dtypes)))
    sample = "\nunion all\n".join(f"select 'sample', rk, '{c}', cast({c} as varchar) from first_rows" for c, _ in fields)
    order = ", ".join(f"{c} nulls first" for c, _ in fields)
    return f"""with {_primary_ctes(src, fields)},
{_semantic_cte(fields)},
first_rows as (select *, row_number() over (order by {order}) - 1 as rk from {src} order by {order} limit 10)
select field, cast(position as bigint) as position, name, value from (
select 'shape' as field, 0 as position, 'rows' as name, cast(count(*) as varchar) as value from {src}
union all select 'shape', 0, 'columns', '{len(fields)}'
union all select 'truncated_columns', 0, '', '0'
union all select 'dataset_type', 0, '', case when count(*) filter (where role = 'date') > 0 then 'Time Series'
  when count(*) filter (where role = 'categorical') > 0 then 'Cross-sectional'
  when count(*) filter (where role = 'numeric') > 0 then 'Numeric Only' else 'Unstructured' end from roles
union all select 'primary_measure', 0, '', "column" from ({_primary_pick("cast(null as int)")})
union all {columns}
union all select 'schema', row_number() over (partition by role order by position) - 1, role, "column" from roles
  where role in ('numeric', 'categorical', 'date', 'id', 'boolean')
union all select 'semantic_roles', row_number() over (partition by semantic_role order by {_ROLE_ORDER}, position) - 1,
  semantic_role, "column" from m join roles using ("column") where role in ('numeric', 'categorical', 'date', 'id', 'boolean')
union all {sample})"""


_PROFILE_JSON = ("shape map<string,string>, dataset_type string, columns array<struct<name:string,dtype:string,missing_pct:double>>, "
                 "schema map<string,array<string>>, semantic_roles map<string,array<string>>, primary_measure string, "
                 "sample_rows array<map<string,string>>, truncated_columns string")


@register("profile_json", _profile_json_sql("events", ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]))
def profile_json(spark, sf):
    """The fields of the JSON summary, parsed back from its text."""
    doc = P.profile_json(table(spark, sf, "events")).select(F.from_json("json", _PROFILE_JSON).alias("d")).select("d.*")
    out = doc.select(F.lit("shape").alias("field"), F.lit(0).alias("position"), F.explode("shape").alias("name", "value"))
    for c in ("dataset_type", "primary_measure", "truncated_columns"):
        out = out.unionByName(doc.select(F.lit(c).alias("field"), F.lit(0).alias("position"), F.lit("").alias("name"), F.col(c).alias("value")))
    cols = doc.select(F.posexplode("columns").alias("position", "c"))
    for c in ("dtype", "missing_pct"):
        out = out.unionByName(cols.select(F.lit(c).alias("field"), "position", F.col("c.name").alias("name"),
                                          F.col(f"c.{c}").cast("string").alias("value")))
    for c in ("schema", "semantic_roles"):
        lists = doc.select(F.explode(c).alias("name", "list")).select("name", F.posexplode("list").alias("position", "value"))
        out = out.unionByName(lists.select(F.lit(c).alias("field"), "position", "name", "value"))
    sample = doc.select(F.posexplode("sample_rows").alias("position", "row")).select("position", F.explode("row").alias("name", "value"))
    return finish(out.unionByName(sample.select(F.lit("sample").alias("field"), "position", "name", "value")))


# -------------------------------------------------------------------- ingest
@register("coerce_money", with_sales("""
c as (select try_cast(regexp_replace(list_price_text, '[,$€£¥%\\s]', '', 'g') as double) as v from sales_wide)
select 'list_price_text' as "column", count(v) as n, round(sum(v), 2) as total, round(min(v), 2) as min,
       round(max(v), 2) as max from c"""))
def coerce_money(spark, sf):
    df, conv = I.coerce_money(sales_wide(spark, sf))
    c = conv[0]
    return finish(df.agg(F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(c).alias("total"),
                         F.min(c).alias("min"), F.max(c).alias("max")))


@register("coerce_dates", """
select o_orderkey, try_strptime(case when o_orderstatus = 'P' then 'n/a'
                                     else strftime(o_orderdate, '%Y-%m-%d') end, '%Y-%m-%d') as created_at
from orders""")
def coerce_dates(spark, sf):
    o = table(spark, sf, "orders")
    txt = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "n/a")
                   .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"))
    return I.coerce_dates(txt, {"created_at": "yyyy-MM-dd"})


@register("narrow_types", "\nunion all\n".join(
    f"""select '{c}' as "column", '{t}' as from_type,
  case when min({c}) >= -128 and max({c}) <= 127 then 'tinyint'
       when min({c}) >= -32768 and max({c}) <= 32767 then 'smallint'
       when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int' else 'bigint' end as to_type
from lineitem""" for c, t in [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                               ("l_linenumber", "int")]))
def narrow_types(spark, sf):
    return I.narrow_plan(table(spark, sf, "lineitem"))


@register("normalize_missing", """
select count(*) filter (where l_discount is null) as discount_missing,
       count(*) filter (where l_tax is null) as tax_missing, count(*) as rows
from (select case when l_discount = 0 then null else l_discount end as l_discount,
             case when l_tax = 0 then null else l_tax end as l_tax from lineitem)""")
def normalize_missing(spark, sf):
    # NaN planted where the value is 0 (a derived input); T1 must count it as missing
    li = table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"))
    n = I.normalize_missing(li)
    return n.agg(F.count_if(F.col("l_discount").isNull()).alias("discount_missing"),
                 F.count_if(F.col("l_tax").isNull()).alias("tax_missing"), F.count(F.lit(1)).alias("rows"))


def _semantic_sql() -> str:
    fields = _sales_fields()
    return with_sales(roles_cte("sales_wide", fields) + ",\n" + _semantic_cte(fields)) + f"""
select semantic_role, cast(row_number() over (partition by semantic_role order by {_ROLE_ORDER}, position) as bigint) as rank,
       "column"
from m join roles using ("column") where role in ('numeric', 'categorical', 'date', 'id', 'boolean')"""


@register("semantic_roles_sales", _semantic_sql())
def semantic_roles_sales(spark, sf):
    prof = P.build_profile(sales_wide(spark, sf))
    rows = [(role, i + 1, c) for role, cols in prof.semantic_roles.items() for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "semantic_role string, rank long, column string")
