"""Registered queries: filters (F1-F5), scalar functions (C1-C7), preview
(IO5)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tablelens.functions import names as N
from tablelens.functions import scalar as S
from tablelens.functions.columns import qcol
from tablelens.operators import filters as FL
from tablelens.operators import ingest as ING
from tablelens.plans.catalog import finish, register, table
from tablelens.session import ensure_checkpoint_dir
from tablelens.sources import files as IO


@register("filter_date", """
with b as (select cast(cast(min(ts) as date) as timestamp) as lo, cast(cast(max(ts) as date) as timestamp) as hi
           from events)
select count(*) filter (where ts >= lo and ts <= hi) as shown, count(*) as total,
       round(sum(value) filter (where ts >= lo and ts <= hi), 2) as value
from events, b""")
def filter_date(spark, sf):
    ev = table(spark, sf, "events")
    f = FL.filter_date(ev, "ts")
    return finish(FL.shown_of_total(f, ev, value=F.sum("value").alias("value")))


@register("filter_date_eod", """
with b as (select cast(cast(min(ts) as date) as timestamp) as lo,
                  cast(cast(max(ts) as date) as timestamp) + interval 1 day as hi from events)
select count(*) filter (where ts >= lo and ts < hi) as shown, count(*) as total from events, b""")
def filter_date_eod(spark, sf):
    ev = table(spark, sf, "events")
    return FL.shown_of_total(FL.filter_date(ev, "ts", end_of_day=True), ev)


@register("filter_values", """
select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as value from orders
where o_orderstatus in ('F', 'O') group by 1""")
def filter_values(spark, sf):
    o = FL.filter_values(table(spark, sf, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": []})
    return finish(o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum("o_totalprice").alias("value")))


@register("filter_options", """
select 'o_orderstatus' as "column", o_orderstatus as value from orders where o_orderstatus is not null
group by 2 having (select count(distinct o_orderstatus) from orders) between 2 and 100
union all
select 'o_orderpriority', o_orderpriority from orders where o_orderpriority is not null
group by 2 having (select count(distinct o_orderpriority) from orders) between 2 and 100""")
def filter_options(spark, sf):
    return FL.filter_options(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("filter_number", """
select count(*) as shown, round(sum(l_extendedprice), 2) as value from lineitem
where l_quantity >= 10 and l_quantity <= 20""")
def filter_number(spark, sf):
    f = FL.filter_number(table(spark, sf, "lineitem"), "l_quantity", 10, 20)
    return finish(f.agg(F.count(F.lit(1)).alias("shown"), F.sum("l_extendedprice").alias("value")))


@register("filter_all", """
select count(*) filter (where o_orderdate >= timestamp '1997-01-01' and o_orderdate <= timestamp '1998-12-31'
                        and o_orderpriority in ('1-URGENT', '2-HIGH')
                        and o_totalprice >= 50000 and o_totalprice <= 300000) as shown,
       count(*) as total
from orders""")
def filter_all(spark, sf):
    o = table(spark, sf, "orders")
    f = FL.filter_all(o, "o_orderdate", (dt.date(1997, 1, 1), dt.date(1998, 12, 31)),
                      {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "o_totalprice", (50000, 300000))
    return FL.shown_of_total(f, o)


@register("drop_missing", """
select count(*) as n from lineitem where nullif(l_discount, 0) is not null and nullif(l_tax, 0) is not null""")
def drop_missing(spark, sf):
    li = table(spark, sf, "lineitem").select(F.expr("nullif(l_discount, 0)").alias("d"),
                                             F.expr("nullif(l_tax, 0)").alias("t"))
    return FL.drop_missing(li, ["d", "t"]).agg(F.count(F.lit(1)).alias("n"))


def _fmt_sql(x: str) -> str:
    r = "cast(round(cast({e} as decimal(38,10)), {d}) as double)"
    return f"""case when {x} is null or isnan({x}) then '—'
  when abs({x}) >= 1e9 then printf('%.2fB', {r.format(e=f'{x} / 1e9', d=2)})
  when abs({x}) >= 1e6 then printf('%.2fM', {r.format(e=f'{x} / 1e6', d=2)})
  when abs({x}) >= 1e3 then printf('%.1fK', {r.format(e=f'{x} / 1e3', d=1)})
  when {x} = floor({x}) then cast(cast({x} as bigint) as varchar)
  else printf('%.2f', {r.format(e=x, d=2)}) end"""


@register("fmt_number", f"""
select o_orderkey, {_fmt_sql('cast(o_totalprice as double)')} as total_fmt,
       {_fmt_sql('cast(o_custkey as double)')} as cust_fmt,
       {_fmt_sql('cast(o_totalprice / 1000 as double)')} as small_fmt
from orders""")
def fmt_number(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.fmt_number(F.col("o_totalprice")).alias("total_fmt"),
                    S.fmt_number(F.col("o_custkey")).alias("cust_fmt"),
                    S.fmt_number(F.col("o_totalprice") / 1000).alias("small_fmt"))


@register("date_labels", """
select distinct cast(last_day(o_orderdate) as date) as month, year(o_orderdate) as year,
       strftime(o_orderdate, '%B') as month_name, strftime(o_orderdate, '%b') as month_abbr,
       strftime(o_orderdate, '%b %Y') as month_year, strftime(o_orderdate, '%B %Y') as month_year_long,
       strftime(last_day(o_orderdate), '%Y-%m-%d') as iso
from orders""")
def date_labels(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return finish(o.select(F.last_day(d.cast("date")).alias("month"), S.year(d).alias("year"),
                           S.month_name(d).alias("month_name"), S.month_abbr(d).alias("month_abbr"),
                           S.month_year(d).alias("month_year"), S.month_year(d, True).alias("month_year_long"),
                           S.iso_date(F.last_day(d.cast("date"))).alias("iso")).distinct())


@register("number_tokens", r"""
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d[\d,.]*%?'))), '|') as tokens
from documents""")
def number_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(S.number_tokens(F.col("text")), "|").alias("tokens"))


@register("extract_json", """
with t as (select event_id, regexp_replace(trim(props), '^```(?:json)?\\s*|\\s*```$', '', 'gm') as t from events),
c as (select event_id, t, regexp_extract(t, '\\[.*\\]', 0, 's') as arr, regexp_extract(t, '\\{.*\\}', 0, 's') as obj
      from t),
j as (select event_id, case when json_valid(t) then t
                            when arr <> '' and json_valid(arr) then arr
                            when arr = '' and obj <> '' and json_valid(obj) then obj end as json from c)
select event_id, json, cast(json_extract(json, '$.k') as bigint) as k from j""")
def extract_json(spark, sf):
    ev = table(spark, sf, "events")
    j = ev.select("event_id", S.extract_json(F.col("props")).alias("json"))
    return j.select("event_id", "json", F.get_json_object("json", "$.k").cast("long").alias("k"))


@register("preview", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate,
       o_orderpriority
from orders order by o_orderkey nulls first, o_custkey nulls first, o_orderstatus nulls first,
  o_totalprice nulls first, o_orderdate nulls first, o_orderpriority nulls first limit 10""")
def preview(spark, sf):
    from tablelens.sources.files import preview as pv
    return pv(table(spark, sf, "orders"), 10)


@register("csv_infer", """
select 'bigint double boolean string decimal(38,0) bigint string string string' as types, count(*) as rows,
       cast(sum(l_orderkey) as bigint) as whole, round(sum(l_extendedprice), 2) as fraction,
       count(*) filter (where l_linenumber % 2 = 0) as yes, min(length(' ' || l_shipmode)) as padded,
       '9' || lpad(cast(max(l_orderkey) as varchar), 24, '0') as large,
       count(*) filter (where l_linenumber % 3 <> 0) as present,
       count(distinct 'line' || chr(10) || l_returnflag) as texts,
       count(*) as padded_na, count(*) filter (where l_linenumber % 3 <> 0) as blanks
from (select *, l_returnflag as l_shipmode from lineitem)""")
def csv_infer(spark, sf):
    """T1b over text columns as a CSV reader gives them."""
    text = table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) as whole", "concat(' ', cast(l_extendedprice as string)) as fraction",
        "if(l_linenumber % 2 = 0, 'True', 'FALSE') as flag", "concat(' ', l_returnflag) as padded",
        "concat('9', lpad(cast(l_orderkey as string), 24, '0')) as large",
        "if(l_linenumber % 3 = 0, 'NA', cast(l_linenumber as string)) as present",
        "concat('line\\n', l_returnflag) as texts",
        "if(l_linenumber % 2 = 0, ' NA ', l_returnflag) as padded_na",
        "case l_linenumber % 3 when 0 then 'null' when 1 then '  ' else l_returnflag end as blanks")
    typed = IO.infer_types(text)
    return finish(typed.agg(
        F.lit(" ".join(t for _, t in typed.dtypes)).alias("types"), F.count(F.lit(1)).alias("rows"),
        F.sum("whole").alias("whole"), F.sum("fraction").alias("fraction"), F.count_if("flag").alias("yes"),
        F.min(F.length("padded")).alias("padded"), F.max("large").cast("string").alias("large"),
        F.count("present").alias("present"), F.count_distinct("texts").alias("texts"),
        F.count("padded_na").alias("padded_na"), F.count("blanks").alias("blanks")))


# Text layouts of one date column, each to be detected from all its values.
_LAYOUTS = {"zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'", "offset": "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "minutes": "yyyy-MM-dd HH:mm",
            "slashes": "MM/dd/yyyy HH:mm", "dotted.name": "dd.MM.yyyy", "words": "MMMM d, yyyy"}


@register("detect_dates", "\nunion all ".join(
    f"select '{name}' as \"column\", strftime(min(o_orderdate), '%Y-%m-%d') as first, "
    f"strftime(max(o_orderdate), '%Y-%m-%d') as last, count(o_orderdate) as parsed from orders" for name in _LAYOUTS)
    + "\nunion all select 'mixed', null, null, 0")
def detect_dates(spark, sf):
    """One layout per column; a column with one other value is no date."""
    o = table(spark, sf, "orders")
    first = o.agg(F.min("o_orderkey")).collect()[0][0]
    mixed = F.when(F.col("o_orderkey") == first, F.lit("n/k")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = o.select(*[F.date_format("o_orderdate", fmt).alias(name) for name, fmt in _LAYOUTS.items()],
                    mixed.alias("mixed"))
    found = {**dict.fromkeys(text.columns), **ING.detect_date_formats(text, text.columns)}
    dates = ING.coerce_dates(text, {c: fmt for c, fmt in found.items() if fmt})
    figures = []
    for c in text.columns:
        d = qcol(c) if found[c] else F.lit(None).cast("timestamp_ntz")
        figures.append(F.struct(F.lit(c).alias("column"), F.date_format(F.min(d), "yyyy-MM-dd").alias("first"),
                                F.date_format(F.max(d), "yyyy-MM-dd").alias("last"), F.count(d).alias("parsed")))
    return dates.agg(F.array(*figures).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@register("csv_round_trip", """
select count(*) as rows, cast(sum(o_orderkey) as bigint) as keys, round(sum(o_totalprice), 2) as value,
       count(distinct 'a "' || o_orderpriority || '"' || chr(10) || 'b, ') as notes,
       cast(sum(length('a "' || o_orderpriority || '"' || chr(10) || 'b, ')) as bigint) as chars,
       count(*) filter (where o_orderkey % 5 <> 0) as present from orders""")
def csv_round_trip(spark, sf):
    """IO3 then IO1: quotes, line breaks, commas, blanks and gaps come back as written."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-stage/{uuid.uuid4().hex}"
    IO.write_csv(table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "concat('a \"', o_orderpriority, '\"\\n', 'b, ') as note",
        "if(o_orderkey % 5 = 0, null, o_orderstatus) as gap"), path)
    back = IO.read_csv(spark, path)
    return finish(back.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"), F.sum("o_totalprice").alias("value"),
        F.count_distinct("note").alias("notes"), F.sum(F.length("note")).alias("chars"), F.count("gap").alias("present")))


@register("empty_guard", """
select 'all' as part, count(*) = 0 as empty from orders
union all select 'paid', count(*) = 0 from orders where o_totalprice > 0
union all select 'refunded', count(*) = 0 from orders where o_totalprice < 0""")
def empty_guard(spark, sf):
    """IO2 over a table, a filter that keeps rows and one that keeps none."""
    o = table(spark, sf, "orders")
    parts = {"all": o, "paid": o.where("o_totalprice > 0"), "refunded": o.where("o_totalprice < 0")}
    return spark.createDataFrame([(k, IO.is_empty(d)) for k, d in parts.items()], "part string, empty boolean")


@register("name_tokens", """
with n as (select distinct p_type || '_' || replace(initcap_name, ' ', '') || cast(p_size as varchar) || 'No' as name
           from (select *, upper(p_brand[1]) || lower(p_brand[2:]) as initcap_name from part)),
w as (select name, unnest(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')),
                                             '[^a-z0-9]+')) as word from n)
select name, string_agg(distinct word, ' ' order by word) as words from w where word <> '' group by name""")
def name_tokens(spark, sf):
    """The words of names with separators, digits and inner capitals."""
    name = F.concat("p_type", F.lit("_"), F.replace(F.concat(F.upper(F.substring("p_brand", 1, 1)),
                                                             F.lower(F.expr("substring(p_brand, 2)"))), F.lit(" "), F.lit("")),
                    F.col("p_size").cast("string"), F.lit("No"))
    names = table(spark, sf, "part").select(name.alias("name")).distinct()
    return names.select("name", F.concat_ws(" ", F.array_sort(N.tokens_expr(F.col("name")))).alias("words"))
