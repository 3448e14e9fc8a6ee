"""Registered queries: distributions and statistics (A7, A8, A8b, A10, A11,
A18, A21, P7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import distribution as D
from tablelens.plans.catalog import finish, register, sales_wide, table, with_sales
from tablelens.session import stage

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
SALES_NUM = ["order_id", "quantity", "revenue", "profit"]


def _hist_sql(src: str, v: str, bins: int = 30) -> str:
    return f"""
with v as (select cast({v} as double) as v from {src} where {v} is not null),
b as (select min(v) as mn, max(v) as mx from v),
c as (select cast(case when mx > mn then least(floor((v - mn) * {bins} / (mx - mn)) + 1, {bins}) else 1 end
                  as bigint) as bin, count(*) as count from v, b group by 1),
s as (select cast(g.bin as bigint) as bin, mn, mx, case when mx > mn then {bins} else 1 end as nb
      from b, generate_series(1, case when mx > mn then {bins} else 1 end) as g(bin) where mn is not null)
select s.bin, round(mn + (s.bin - 1) * ((mx - mn) / nb), 4) as lo, round(mn + s.bin * ((mx - mn) / nb), 4) as hi,
       coalesce(c.count, 0) as count
from s left join c using (bin)"""


@register("histogram30", _hist_sql("lineitem", "l_extendedprice"))
def histogram30(spark, sf):
    return finish(D.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30), 4)


def _box_tail(long_cte: str) -> str:
    return long_cte + """,
s as (select label, count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
             quantile_cont(v, 0.75) as q3 from l group by label),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence
      from s),
w as (select l.label,
             min(case when v >= lower_fence and v <= upper_fence then v end) as whisker_low,
             max(case when v >= lower_fence and v <= upper_fence then v end) as whisker_high,
             count(*) filter (where not (v >= lower_fence and v <= upper_fence)) as outliers
      from l join f using (label) group by 1)
select f.label, n, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
       round(iqr, 4) as iqr, round(lower_fence, 4) as lower_fence, round(upper_fence, 4) as upper_fence,
       round(whisker_low, 4) as whisker_low, round(whisker_high, 4) as whisker_high,
       round(median - 1.57 * iqr / sqrt(n), 4) as notch_low,
       round(median + 1.57 * iqr / sqrt(n), 4) as notch_high, outliers
from f join w using (label)"""


@register("box_by_category", _box_tail("""
with g as (select cast(p_brand as varchar) as label, count(*) as count from part
           where p_brand is not null group by 1),
top as (select label from g order by count desc, label asc limit 8),
l as (select cast(p_brand as varchar) as label, cast(p_retailprice as double) as v from part
      where p_brand in (select label from top) and p_retailprice is not null)"""))
def box_by_category(spark, sf):
    # multi-pass operators (counts, quartiles, fences) read a staged input
    return finish(D.box_by_category(table(spark, sf, "part"), "p_brand", "p_retailprice", 8), 4)


def _outlier_sql(src: str, cols: list[str], with_prefix: str = "with ") -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""
select '{c}' as "column", cast({i} as bigint) as position,
  count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as iqr_outliers,
  count(*) filter (where abs((v - m) / (s + 1e-9)) > 3) as zscore_outliers,
  round(min(v), 2) as min, round(max(v), 2) as max, round(avg(v), 2) as mean,
  round(stddev_samp(v), 2) as std,
  round(round(count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) / count(v) * 100, 2), 2)
    as pct_of_rows,
  round(q1, 4) as q1, round(q3, 4) as q3
from (select cast({c} as double) as v from {src} where {c} is not null) x,
     (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3,
             avg(cast({c} as double)) as m, stddev_samp(cast({c} as double)) as s from {src}) st
group by q1, q3, m, s having count(v) >= 5""")
    return "\nunion all\n".join(parts)


@register("outliers", _outlier_sql("lineitem", LINEITEM_NUM))
def outliers(spark, sf):
    return finish(D.outliers(table(spark, sf, "lineitem"), LINEITEM_NUM), 2, q1=4, q3=4)


@register("outliers_sales", with_sales("x as (select 1)\n" + _outlier_sql("sales_wide", SALES_NUM)))
def outliers_sales(spark, sf):
    return finish(D.outliers(stage(sales_wide(spark, sf), "table"), SALES_NUM), 2, q1=4, q3=4)


def _box_columns_sql() -> str:
    o = _outlier_sql("lineitem", LINEITEM_NUM)
    cols = LINEITEM_NUM
    unions = "\nunion all\n".join(
        f"select '{c}' as label, cast({c} as double) as v from lineitem where {c} is not null" for c in cols)
    return _box_tail(f"""
with o as ({o}),
top as (select "column" as label from o order by iqr_outliers desc, position asc limit 2),
allv as ({unions}),
l as (select * from allv where label in (select label from top))""")


@register("box_columns", _box_columns_sql())
def box_columns(spark, sf):
    return finish(D.box_columns(table(spark, sf, "lineitem"), LINEITEM_NUM, 2), 4)


@register("violin_bins", """
with g as (select cast(p_type as varchar) as label, count(*) as count from part
           where p_type is not null group by 1),
top as (select label from g order by count desc, label asc limit 6),
l as (select cast(p_type as varchar) as label, cast(p_retailprice as double) as v from part
      where p_type in (select label from top) and p_retailprice is not null),
b as (select label, min(v) as mn, max(v) as mx from l group by 1),
c as (select label, cast(case when mx > mn then least(floor((v - mn) * 30 / (mx - mn)) + 1, 30) else 1 end
                         as bigint) as bin, count(*) as count
      from l join b using (label) group by 1, 2),
s as (select label, mn, mx, cast(g.bin as bigint) as bin, case when mx > mn then 30 else 1 end as nb
      from b, generate_series(1, case when mx > mn then 30 else 1 end) as g(bin))
select s.label, s.bin, round(mn + (s.bin - 1) * ((mx - mn) / nb), 4) as lo,
       round(mn + s.bin * ((mx - mn) / nb), 4) as hi, coalesce(c.count, 0) as count
from s left join c using (label, bin)""")
def violin_bins(spark, sf):
    return finish(D.violin_bins(table(spark, sf, "part"), "p_type", "p_retailprice", 6, 30), 4)


@register("violin_density", """
with g as (select cast(p_type as varchar) as label, count(*) as count from part
           where p_type is not null group by 1),
top as (select label from g order by count desc, label asc limit 6),
l as (select cast(p_type as varchar) as label, cast(p_retailprice as double) as v from part
      where p_type in (select label from top) and p_retailprice is not null),
b as (select label, min(v) as mn, max(v) as mx, count(*) as n, 1.059 * stddev_samp(v) * pow(count(*), -0.2) as h
      from l group by 1 having max(v) > min(v)),
c as (select label, least(floor((v - mn) * 200 / (mx - mn)) + 1, 200) as bin, count(*) as count
      from l join b using (label) group by 1, 2),
p as (select label, mn, mx, n, h, cast(g.point as bigint) as point,
             mn - 2 * h + g.point * ((mx - mn + 4 * h) / 99) as x from b, generate_series(0, 99) as g(point))
select label, point, round(min(x), 4) as x,
       round(sum(c.count * exp(-0.5 * pow((x - (mn + (bin - 0.5) * ((mx - mn) / 200))) / h, 2)) / (n * h * sqrt(2 * pi()))), 8) as density
from p join c using (label) group by label, point""")
def violin_density(spark, sf):
    return finish(D.violin_density(table(spark, sf, "part"), "p_type", "p_retailprice", 6, 200, 100), 4, density=8)


def _corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            both = f"{a} is not null and {b} is not null"
            pa = f"case when {both} then cast({a} as double) end"
            pb = f"case when {both} then cast({b} as double) end"
            parts.append(
                f"select '{a}' as col_a, '{b}' as col_b, cast({i} as bigint) as pos_a, cast({j} as bigint) as pos_b, "
                f"round(covar_pop({pa}, {pb}) / nullif(stddev_pop({pa}) * stddev_pop({pb}), 0), 6) as r from {src}")
    return "\nunion all\n".join(parts)


@register("corr_matrix", with_sales("c as (" + _corr_sql("sales_wide", SALES_NUM) + ")\nselect * from c"))
def corr_matrix(spark, sf):
    return finish(D.corr_pairs(sales_wide(spark, sf), SALES_NUM), 6)


@register("corr_top10", "with c as (" + _corr_sql("lineitem", LINEITEM_NUM) + """)
select * from c where r is not null and not isnan(r) order by abs(r) desc, pos_a, pos_b limit 10""")
def corr_top10(spark, sf):
    return finish(D.corr_top(table(spark, sf, "lineitem"), LINEITEM_NUM, 10), 6)


@register("strongest_corr", "with c as (" + _corr_sql("lineitem", LINEITEM_NUM) + """)
select case when col_a = 'l_quantity' then col_b else col_a end as "column", r from c
where (col_a = 'l_quantity' or col_b = 'l_quantity') and r is not null
order by abs(r) desc, case when col_a = 'l_quantity' then pos_b else pos_a end limit 1""")
def strongest_corr(spark, sf):
    return finish(D.strongest_corr(table(spark, sf, "lineitem"), "l_quantity", LINEITEM_NUM), 6)


@register("scatter_sample", """
with s as (select o_orderkey as key, o_custkey as x, o_totalprice as y, cast(o_orderpriority as varchar) as color
           from orders order by md5(concat(cast(o_orderkey as varchar), '42')) limit 2000),
nc as (select count(distinct color) as nc from s)
select key, x, round(y, 2) as y, case when nc <= 12 then color end as color from s, nc""")
def scatter_sample(spark, sf):
    return finish(D.scatter_sample(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey",
                                   "o_orderpriority"))


def _sample_sql(x: str, y: str, color: str) -> str:
    """A21 without a key: equal points numbered, ordered by the md5 of point and number."""
    return f"""
with p as (select {x} as x, {y} as y, {color} as color from lineitem),
c as (select *, cast(row_number() over (partition by x, y, color) - 1 as varchar) as copy from p)
select x, y, color from c
order by md5(coalesce(cast(x as varchar), '~') || '|' || coalesce(cast(y as varchar), '~') || '|'
             || coalesce(color, '~') || '|' || copy || '|42'), x, y, color limit 2000"""


@register("scatter_repeated", _sample_sql("l_linenumber", "l_discount", "l_returnflag"))
def scatter_repeated(spark, sf):
    return D.scatter_sample(table(spark, sf, "lineitem"), "l_linenumber", "l_discount", color="l_returnflag")


@register("scatter_by_place", """
with r as (select *, row_number() over () - 1 as place from lineitem),
s as (select l_quantity as x, l_extendedprice as y, l_returnflag as color from r where l_discount > 0.02
      order by md5('lineitem.parquet|' || cast(place as varchar) || '|42') limit 2000)
select x, y, color from s""")
def scatter_by_place(spark, sf):
    li = table(spark, sf, "lineitem").where("l_discount > 0.02")
    return D.scatter_sample(li, "l_quantity", "l_extendedprice", color="l_returnflag", file="_metadata.file_name")


@register("scatter_nulls", _sample_sql("case when l_linenumber % 3 = 0 then l_linenumber end", "l_tax", "l_linestatus"))
def scatter_nulls(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("x", F.expr("case when l_linenumber % 3 = 0 then l_linenumber end"))
    return D.scatter_sample(li, "x", "l_tax", color="l_linestatus")


@register("scatter_doubles", _sample_sql("l_discount", "l_tax", "cast(null as varchar)"))
def scatter_doubles(spark, sf):
    return D.scatter_sample(table(spark, sf, "lineitem").select("l_discount", "l_tax"), "l_discount", "l_tax")


@register("describe_numeric", """
select 'l_extendedprice' as "column", count(l_extendedprice) as n,
       count(*) filter (where l_extendedprice is null) as missing,
       round(count(*) filter (where l_extendedprice is null) / count(*) * 100, 4) as missing_pct,
       round(min(l_extendedprice), 4) as min, round(max(l_extendedprice), 4) as max,
       round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std,
       round(median(l_extendedprice), 4) as median, round(quantile_cont(l_extendedprice, 0.25), 4) as p25,
       round(quantile_cont(l_extendedprice, 0.75), 4) as p75
from lineitem""")
def describe_numeric(spark, sf):
    return finish(D.describe_numeric(table(spark, sf, "lineitem"), "l_extendedprice"), 4)


@register("describe_date", """
select 'o_orderdate' as "column", strftime(min(o_orderdate), '%Y-%m-%d') as first,
       strftime(max(o_orderdate), '%Y-%m-%d') as last,
       cast(datesub('day', min(o_orderdate), max(o_orderdate)) as bigint) as days,
       count(*) filter (where o_orderdate is null) as missing,
       round(count(*) filter (where o_orderdate is null) / count(*) * 100, 4) as missing_pct
from orders""")
def describe_date(spark, sf):
    return finish(D.describe_date(table(spark, sf, "orders"), "o_orderdate"), 4)


@register("describe_categorical", """
with g as (select cast(p_type as varchar) as label, count(*) as count from part
           where p_type is not null group by 1),
top as (select label, count, row_number() over (order by count desc, label asc) as rank from g
        order by count desc, label asc limit 5),
st as (select count(distinct p_type) as nunique, count(*) filter (where p_type is null) as missing,
              round(count(*) filter (where p_type is null) / count(*) * 100, 4) as missing_pct from part)
select 'p_type' as "column", nunique, missing, missing_pct, rank, label as value, count from top, st""")
def describe_categorical(spark, sf):
    return finish(D.describe_categorical(table(spark, sf, "part"), "p_type", 5), 4)
