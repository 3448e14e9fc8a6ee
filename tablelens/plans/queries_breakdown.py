"""Registered queries: category breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import breakdown as B
from tablelens.plans.catalog import finish, register, sales_wide, table, with_sales
from tablelens.session import stage


def _gsum(t, x, y, where="true"):
    return (f"g as (select cast({x} as varchar) as label, coalesce(sum({y}), 0) as value "
            f"from {t} where {x} is not null and {where} group by 1)")


def _top_sql(n, by="value"):
    return (f"top as (select *, row_number() over (order by {by} desc, label asc) as rank "
            f"from g order by {by} desc, label asc limit {n})")


@register("bar_top15", with_sales(_gsum("sales_wide", "country", "revenue") + "," + _top_sql(15) + """
select label, round(value, 2) as value, rank from top"""))
def bar_top15(spark, sf):
    return finish(B.bar_top(sales_wide(spark, sf), "country", "revenue", 15))


@register("category_frequency", """
with g as (select cast(p_type as varchar) as label, count(*) as count from part
           where p_type is not null group by 1),
""" + _top_sql(15, "count") + """
select label, count, rank from top""")
def category_frequency(spark, sf):
    return finish(B.category_frequency(table(spark, sf, "part"), "p_type", 15))


@register("top_words", """
with w as (select unnest(string_split(text, ' ')) as word from documents),
g as (select word as label, count(*) as count from w where word <> '' group by 1),
""" + _top_sql(25, "count") + """
select label, count, rank from top""")
def top_words(spark, sf):
    """A2 over a column of very many labels: the words of all documents."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return finish(B.category_frequency(words, "word", 25, many=True))


@register("bar_top_many", "with " + _gsum("lineitem", "l_orderkey", "l_extendedprice - 20000") + "," + _top_sql(15) + """
select label, round(value, 2) as value, rank from top""")
def bar_top_many(spark, sf):
    """A1 over a column of very many labels, with a measure of both signs."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") - 20000).alias("margin"))
    return finish(B.bar_top(lines, "l_orderkey", "margin", 15, many=True))


@register("share_sum", "with " + _gsum("orders", "o_orderpriority", "o_totalprice") + "," + _top_sql(10)
          + """
select label, round(value, 2) as value, rank, round(value * 100 / sum(value) over (), 6) as pct
from top""")
def share_sum(spark, sf):
    return finish(B.share(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 10), pct=6)


@register("share_count", """
with g as (select cast(c_mktsegment as varchar) as label, cast(count(*) as double) as value
           from customer where c_mktsegment is not null group by 1),
""" + _top_sql(10) + """
select label, value, rank, round(value * 100 / sum(value) over (), 6) as pct from top""")
def share_count(spark, sf):
    return finish(B.share(table(spark, sf, "customer"), "c_mktsegment", None, 10), pct=6)


@register("treemap", "with " + _gsum("part", "p_brand", "p_retailprice") + """
select label, round(value, 2) as value from g""")
def treemap(spark, sf):
    return finish(B.treemap(table(spark, sf, "part"), "p_brand", "p_retailprice"))


@register("funnel", with_sales(_gsum("sales_wide", "region", "revenue") + "," + _top_sql(8) + """
select label, round(value, 2) as value, rank, round(value * 100 / sum(value) over (), 6) as pct
from top"""))
def funnel(spark, sf):
    return finish(B.funnel(sales_wide(spark, sf), "region", "revenue", 8), pct=6)


@register("pareto15", with_sales(_gsum("sales_wide", "product", "revenue") + "," + _top_sql(15) + """
select label, round(value, 2) as value, rank,
       round(sum(value) over (order by rank rows between unbounded preceding and current row) * 100
             / sum(value) over (), 6) as cumulative_pct
from top"""))
def pareto15(spark, sf):
    return finish(B.pareto(sales_wide(spark, sf), "product", "revenue", 15), cumulative_pct=6)


@register("best_worst", with_sales(_gsum("sales_wide", "country", "profit") + """
select * from (
  (select case when row_number() over (order by value desc, label asc) = 1 then 'best' else 'second' end
          as kind, label, round(value, 2) as value from g order by value desc, label asc limit 2)
  union all
  (select 'worst' as kind, label, round(value, 2) as value from g order by value asc, label asc limit 1))
"""))
def best_worst(spark, sf):
    return finish(B.best_worst(sales_wide(spark, sf), "country", "profit"))


@register("concentration", with_sales(_gsum("sales_wide", "segment", "revenue") + """,
r as (select *, row_number() over (order by value desc, label asc) as rk from g),
a as (select count(*) as n_groups, sum(value) as total,
             max(case when rk = 1 then label end) as top_label,
             max(case when rk = 1 then value end) as top_value,
             sum(case when rk <= 3 then value end) as top3_value from r)
select n_groups, round(total, 2) as total, top_label, round(top_value, 2) as top_value,
       round(case when total <> 0 then top_value / total * 100 else 0 end, 6) as top_share_pct,
       round(case when n_groups >= 3 then case when total <> 0 then top3_value / total * 100 else 0 end end, 6)
         as top3_share_pct,
       coalesce(case when total <> 0 then top_value / total end, 0) > 0.5 as concentrated
from a"""))
def concentration(spark, sf):
    return finish(B.concentration(sales_wide(spark, sf), "segment", "revenue"),
                  top_share_pct=6, top3_share_pct=6)


@register("top_record", with_sales("""
m as (select max(revenue) as mx from sales_wide)
select max(customer_name) as label, round(max(revenue), 2) as value
from sales_wide, m where revenue = m.mx"""))
def top_record(spark, sf):
    return finish(B.top_record(sales_wide(spark, sf), "customer_name", "revenue"))


@register("topk_members", """
with g as (select cast(p_type as varchar) as label, count(*) as count from part
           where p_type is not null group by 1),
""" + _top_sql(8, "count") + """
select p_type as label, count(*) as rows, round(sum(p_retailprice), 2) as value
from part where p_type in (select label from top) group by 1""")
def topk_members(spark, sf):
    rows = B.top_k_members(table(spark, sf, "part"), "p_type", 8)
    return finish(rows.groupBy(F.col("p_type").alias("label"))
                  .agg(F.count(F.lit(1)).alias("rows"), F.sum("p_retailprice").alias("value")))


@register("underserved", with_sales("""
g as (select cast(country as varchar) as label, coalesce(sum(revenue), 0) as total, count(revenue) as n
      from sales_wide where country is not null group by 1 having count(revenue) >= 3),
a as (select *, total / n as avg_value from g),
m as (select median(n) as mc, median(avg_value) as ma from a)
select label, n, round(avg_value, 2) as avg_value from a, m
where n < m.mc and avg_value > m.ma order by avg_value desc, label asc limit 1"""))
def underserved(spark, sf):
    return finish(B.underserved(stage(sales_wide(spark, sf), "table"), "country", "revenue"))
