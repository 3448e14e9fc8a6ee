"""Registered queries: monthly family."""

from __future__ import annotations

from tablelens.operators import monthly as M
from tablelens.plans.catalog import finish, register, table

# Dense month spine in SQL: months between the first and last month with rows.
_SPINE = """
with s as (
  select last_day(cast({d} as date)) as month, sum({v}) as value
  from {t} where {d} is not null and {v} is not null group by 1),
b as (select min(month) as lo, max(month) as hi from s),
spine as (
  select last_day(cast(g.m as date)) as month
  from b, generate_series(cast(date_trunc('month', b.lo) as timestamp),
                          cast(date_trunc('month', b.hi) as timestamp), interval 1 month) as g(m)),
dense as (select spine.month, coalesce(s.value, 0) as value from spine left join s using (month))
"""


def _spine(t, d, v):
    return _SPINE.format(t=t, d=d, v=v)


@register("line_monthly", _spine("orders", "o_orderdate", "o_totalprice") + """
select month, round(value, 2) as value from dense""")
def line_monthly(spark, sf):
    return finish(M.monthly_sum(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("line_monthly_lineitem", _spine("lineitem", "l_shipdate", "l_extendedprice") + """
select month, round(value, 2) as value from dense""")
def line_monthly_lineitem(spark, sf):
    return finish(M.monthly_sum(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice"))


@register("line_monthly_by", """
select last_day(cast(o_orderdate as date)) as month, o_orderpriority as color,
       round(sum(o_totalprice), 2) as value
from orders where o_orderdate is not null and o_totalprice is not null and o_orderpriority is not null
group by 1, 2""")
def line_monthly_by(spark, sf):
    return finish(M.monthly_sum_by(table(spark, sf, "orders"), "o_orderdate", "o_totalprice",
                                   "o_orderpriority"))


@register("cumulative_monthly", _spine("orders", "o_orderdate", "o_totalprice") + """
select month, round(value, 2) as value,
       round(sum(value) over (order by month rows between unbounded preceding and current row), 2)
         as cumulative
from dense""")
def cumulative_monthly(spark, sf):
    return finish(M.cumulative_monthly(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("rolling3_monthly", _spine("lineitem", "l_shipdate", "l_quantity") + """
select month, round(value, 2) as value,
       round(avg(value) over (order by month rows between 2 preceding and current row), 2) as rolling
from dense""")
def rolling3_monthly(spark, sf):
    return finish(M.rolling_monthly(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", 3))


_LAST_TWO = """,
lt as (select month, value, lag(value) over (order by month) as previous,
              count(*) over () as n_months from dense),
last as (select * from lt order by month desc limit 1)
"""


@register("mom_trend_kpi", _spine("orders", "o_orderdate", "o_totalprice") + _LAST_TWO + """
select month, round(value, 2) as current, round(previous, 2) as previous,
       case when previous is not null and abs(previous) >= 1e-9
            then round((value - previous) / abs(previous) * 100, 1) end as trend_pct,
       case when previous is not null and abs(previous) >= 1e-9
            then (value - previous) / abs(previous) * 100 >= 0 end as trend_up
from last""")
def mom_trend_kpi(spark, sf):
    df = M.mom_trend_kpi(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return finish(df)


@register("mom_trend_kpi_events", _spine("events", "ts", "value") + _LAST_TWO + """
select month, round(value, 2) as current, round(previous, 2) as previous,
       case when previous is not null and abs(previous) >= 1e-9
            then round((value - previous) / abs(previous) * 100, 1) end as trend_pct,
       case when previous is not null and abs(previous) >= 1e-9
            then (value - previous) / abs(previous) * 100 >= 0 end as trend_up
from last""")
def mom_trend_kpi_events(spark, sf):
    return finish(M.mom_trend_kpi(table(spark, sf, "events"), "ts", "value"))


@register("mom_trend_insight", _spine("lineitem", "l_shipdate", "l_extendedprice") + _LAST_TWO + """
select month, round(value, 2) as current, round(previous, 2) as previous,
       round((value - previous) / (abs(previous) + 1e-9) * 100, 6) as pct,
       case when (value - previous) / (abs(previous) + 1e-9) * 100 >= 0 then 'grew' else 'fell' end
         as direction
from last where previous is not null""")
def mom_trend_insight(spark, sf):
    return finish(M.mom_trend_insight(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice"),
                  pct=6)


@register("best_worst_month", _spine("orders", "o_orderdate", "o_totalprice") + """
, n as (select count(*) as n from dense)
select * from (
  (select 'best' as kind, month, round(value, 2) as value from dense, n where n.n >= 3
   order by value desc, month asc limit 1)
  union all
  (select 'worst' as kind, month, round(value, 2) as value from dense, n where n.n >= 3
   order by value asc, month asc limit 1))""")
def best_worst_month(spark, sf):
    return finish(M.best_worst_month(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("trajectory", _spine("orders", "o_orderdate", "o_totalprice") + """
, idx as (select value, cast(row_number() over (order by month) - 1 as double) as i from dense)
select count(*) as n_months, round(regr_slope(value, i), 2) as slope,
       case when regr_slope(value, i) > 0 then 'upward' else 'downward' end as direction
from idx having count(*) >= 4""")
def trajectory(spark, sf):
    return finish(M.trajectory(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("date_range", """
select min(ts) as first, max(ts) as last,
       cast(datesub('day', min(ts), max(ts)) as bigint) as days,
       strftime(min(ts), '%b %Y') as first_month, strftime(max(ts), '%b %Y') as last_month
from events""")
def date_range(spark, sf):
    return finish(M.date_range(table(spark, sf, "events"), "ts"))


@register("month_heatmap", """
with p as (select year(o_orderdate) as year, month(o_orderdate) as mon, o_totalprice as v
           from orders where o_orderdate is not null and o_totalprice is not null)
select cast(year as bigint) as year,
  round(sum(case when mon = 1 then v end), 2) as Jan, round(sum(case when mon = 2 then v end), 2) as Feb,
  round(sum(case when mon = 3 then v end), 2) as Mar, round(sum(case when mon = 4 then v end), 2) as Apr,
  round(sum(case when mon = 5 then v end), 2) as May, round(sum(case when mon = 6 then v end), 2) as Jun,
  round(sum(case when mon = 7 then v end), 2) as Jul, round(sum(case when mon = 8 then v end), 2) as Aug,
  round(sum(case when mon = 9 then v end), 2) as Sep, round(sum(case when mon = 10 then v end), 2) as Oct,
  round(sum(case when mon = 11 then v end), 2) as Nov, round(sum(case when mon = 12 then v end), 2) as Dec
from p group by year""")
def month_heatmap(spark, sf):
    return finish(M.month_heatmap(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@register("seasonal_low", """
with bym as (select strftime(o_orderdate, '%B') as month_name, avg(o_totalprice) as avg_value
            from orders where o_orderdate is not null and o_totalprice is not null group by 1)
select month_name, round(avg_value, 2) as avg_value from bym
where (select count(*) from bym) >= 4 order by avg_value asc, month_name asc limit 1""")
def seasonal_low(spark, sf):
    return finish(M.seasonal_low(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))
