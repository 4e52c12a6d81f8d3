"""Queries of joins, aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import aggs as A
from plotline.operators import joins as J
from plotline.operators.stats import correlations, welch, welch_table
from plotline.plans.oracles import student_p
from plotline.plans.registry import Tables, query


@query("""select o_orderkey, c_mktsegment from orders left join customer on o_custkey = c_custkey""")
def left_join_n1(spark, sf):
    t = Tables(spark, sf)
    return J.join_n1(t.orders.withColumnRenamed("o_custkey", "key"), t.customer.select(F.col("c_custkey").alias("key"), "c_mktsegment"), ["key"]).select("o_orderkey", "c_mktsegment")


@query("""select c_custkey, s_name from customer join supplier on c_custkey = s_suppkey""")
def left_join_11(spark, sf):
    t = Tables(spark, sf)
    c, s = t.customer.select(F.col("c_custkey").alias("key")), t.supplier.select(F.col("s_suppkey").alias("key"), "s_name")
    return J.join_11(c, s, ["key"], "inner").select(F.col("key").alias("c_custkey"), "s_name")


@query("""select n_name, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def inner_using(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("""select key, coalesce(a, 0) as a, coalesce(b, 0) as b from (select c_nationkey as key, count(*) as a from customer where c_acctbal > 5000 group by 1) full join (select s_nationkey as key, count(*) as b from supplier where s_acctbal > 5000 group by 1) using (key)""")
def full_outer_fill(spark, sf):
    t = Tables(spark, sf)
    a = t.customer.where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("a"))
    b = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("b"))
    return J.full_outer_filled(a, b, ["key"], {"a": 0, "b": 0}).select("key", "a", "b")


@query("""select n_name, r_name, s from nation cross join region cross join (select distinct o_orderstatus as s from orders)""")
def cross_grid(spark, sf):
    t = Tables(spark, sf)
    return J.grid(t.nation.select("n_name"), t.region.select("r_name"), t.orders.select(F.col("o_orderstatus").alias("s")).distinct())


@query("""select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def semi_filter(spark, sf):
    t = Tables(spark, sf)
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(keys, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')""")
def anti_unmatched(spark, sf):
    t = Tables(spark, sf)
    return J.unmatched(t.customer, t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey", "c_name")


@query("""select a.o_orderkey, b.cnt from (select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as st from orders) a left join (select o_custkey, nullif(o_orderstatus, 'P') as st, count(*) as cnt from orders group by 1, 2) b on a.o_custkey = b.o_custkey and a.st = b.st""")
def composite_null_join(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("st"))
    return o.join(o.groupBy("o_custkey", "st").agg(F.count(F.lit(1)).alias("cnt")), ["o_custkey", "st"], "left").select("o_orderkey", "cnt")


@query("""select count(*) as shared from (select c_custkey from customer intersect select s_suppkey from supplier)""")
def overlap_check(spark, sf):
    t = Tables(spark, sf)
    return t.customer.select("c_custkey").intersect(t.supplier.select("s_suppkey")).agg(F.count(F.lit(1)).alias("shared"))


@query("""select user_id, count(*) as versions, arg_min(event_type, (ts, event_id)) as first_event_type, arg_min(value, (ts, event_id)) as first_value, arg_max(event_type, (ts, event_id)) as last_event_type, arg_max(value, (ts, event_id)) as last_value from events group by user_id""")
def first_last_pair(spark, sf):
    return J.first_and_last(Tables(spark, sf).events, "user_id", [F.col("ts"), F.col("event_id")], ["event_type", "value"])


@query("""select l_returnflag, l_orderkey, l_linenumber, o_orderpriority from lineitem join (select distinct o_orderkey, o_orderpriority from orders) on l_orderkey = o_orderkey where l_linenumber = 1""")
def dimension_rejoin(spark, sf):
    t = Tables(spark, sf)
    dim = J.dimension(t.orders, ["o_orderkey", "o_orderpriority"]).withColumnRenamed("o_orderkey", "l_orderkey")
    return t.lineitem.where("l_linenumber = 1").join(dim, "l_orderkey").select("l_returnflag", "l_orderkey", "l_linenumber", "o_orderpriority")


@query("""select nullif(l_returnflag, 'A') as flag, count(*) as n from lineitem group by 1""")
def group_null_counts(spark, sf):
    return Tables(spark, sf).lineitem.groupBy(F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("""select l_linestatus, count(*) filter (l_discount > 0.05) as discounted, count(*) filter (l_returnflag = 'R') as returned, count(*) as n from lineitem group by l_linestatus""")
def cond_counts(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, arg_min(v, (l_linenumber, l_partkey, l_suppkey, v)) as first_flag from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_returnflag, 'A') as v from lineitem) where v is not null group by l_orderkey""")
def min_by_first_valid(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("v", F.nullif(F.col("l_returnflag"), F.lit("A")))
    g = li.groupBy("l_orderkey").agg(A.first_valid(F.col("v"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("v")).alias("first_flag"))
    return g.where("first_flag is not null")


@query("""select l_orderkey, count(*) as parcels from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem) group by l_orderkey""")
def distinct_row_count(spark, sf):
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parcels"))


@query("""select l_orderkey, string_agg(distinct l_returnflag, ';' order by l_returnflag) as flags from lineitem group by l_orderkey""")
def sorted_distinct_concat(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(A.joined_distinct(F.col("l_returnflag")).alias("flags"))


@query("""select l_orderkey, coalesce(bool_and(x), true) as all_or_none, coalesce(bool_and(x), false) as all_and_some from (select l_orderkey, case when l_returnflag <> 'A' then l_quantity > 10 end as x from lineitem) group by l_orderkey""")
def for_all_quantifier(spark, sf):
    x = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") > 10)
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(A.for_all(x, True).alias("all_or_none"), A.for_all(x, False).alias("all_and_some"))


@query("""select l_returnflag, median(l_extendedprice) as m from lineitem group by l_returnflag""")
def median_group(spark, sf):
    return A.quantiles(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice", {"m": 0.5})


@query("""select l_returnflag, quantile_cont(l_extendedprice, 0.25) as p25, quantile_cont(l_extendedprice, 0.75) as p75, quantile_cont(l_extendedprice, 0.05) as p05, quantile_cont(l_extendedprice, 0.95) as p95 from lineitem group by l_returnflag""")
def quantile_type7(spark, sf):
    return A.quantiles(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p75": 0.75, "p05": 0.05, "p95": 0.95})


_RANKS = """with r as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem) """


@query(_RANKS + "select l_returnflag, max(case when k = ceil((n - 1) * 0.95) then v end) as p95_higher from r group by l_returnflag")
def quantile_higher(spark, sf):
    return A.order_statistic(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice", {"p95_higher": A.higher(0.95)})


@query(_RANKS + "select l_returnflag, max(case when k = (n - 1) // 2 then v end) as low_median, max(case when k = least(n - 1, floor(n * 0.95)) then v end) as p95 from r group by l_returnflag")
def lower_median_p95(spark, sf):
    return A.order_statistic(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice", {"low_median": A.lower_median(), "p95": A.capped(0.95)})


@query("""select l_returnflag, cast(sum(cast(l_extendedprice * l_quantity as decimal(18,4))) filter (l_quantity > 5) as double) / nullif(cast(sum(cast(l_quantity as decimal(18,4))) filter (l_quantity > 5) as double), 0) as wmean from lineitem group by l_returnflag""")
def weighted_mean(spark, sf):
    w = F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0.0)
    return Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(A.weighted_mean(F.col("l_extendedprice"), w).alias("wmean"))


@query("""select c_mktsegment, n_name as top_nation, n from (select c_mktsegment, n_name, count(*) as n, row_number() over (partition by c_mktsegment order by count(*) desc, n_name) as k from customer join nation on c_nationkey = n_nationkey group by 1, 2) where k = 1""")
def argmax_group(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("c_mktsegment").agg(A.arg_max(F.col("n_name"), F.col("n")).alias("top_nation"), F.max("n").alias("n"))


@query("""select l_linestatus, count(*) filter (l_discount > 0.05) * 100.0::double / count(*) as pct from lineitem group by l_linestatus""")
def share_pct(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_linestatus").agg((F.count_if(F.col("l_discount") > 0.05) * F.lit(100.0) / F.count(F.lit(1))).alias("pct"))


@query("""select o_custkey, o_orderpriority as mode, n from (select o_custkey, o_orderpriority, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as k from orders group by 1, 2) where k = 1""")
def mode_tiebreak(spark, sf):
    return A.mode(Tables(spark, sf).orders, ["o_custkey"], "o_orderpriority")


@query("""select user_id, strftime(ts, '%Y-%m-%d') as day, count(distinct event_type) as kinds from events group by 1, 2 having count(distinct event_type) > 1""")
def having_distinct(spark, sf):
    e = Tables(spark, sf).events
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("event_type").alias("kinds")).where("kinds > 1")


@query("""select o_custkey, count(*) as n, median(o_totalprice) as m from orders group by o_custkey having count(*) >= 10""")
def having_min_n(spark, sf):
    return Tables(spark, sf).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.median("o_totalprice").alias("m")).where("n >= 10")


@query("""select o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as total, min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,4))) as double) / count(*) as mean from orders group by o_orderstatus""")
def summary_stats(spark, sf):
    s = A.exact_sum(F.col("o_totalprice"))
    return Tables(spark, sf).orders.groupBy("o_orderstatus").agg(s.alias("total"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n"), (s / F.count(F.lit(1))).alias("mean"))


@query("""select o_orderkey, o_totalprice / (select cast(sum(cast(o_totalprice as decimal(18,4))) as double) / count(*) from orders where year(o_orderdate) = 1998) as relative from orders""")
def scalar_broadcast(spark, sf):
    o = Tables(spark, sf).orders
    base = o.where(F.year("o_orderdate") == 1998).agg((A.exact_sum(F.col("o_totalprice")) / F.count(F.lit(1))).alias("base"))
    return o.crossJoin(base).select("o_orderkey", (F.col("o_totalprice") / F.col("base")).alias("relative"))


@query("""select strftime(o_orderdate, '%Y-%m') as month, count(*) filter (o_orderstatus = 'F') as n1, count(*) filter (o_orderstatus = 'O') as n2, count(*) filter (o_orderstatus = 'P') as n3 from orders group by 1""")
def pivot_fill(spark, sf):
    return A.pivot_counts(Tables(spark, sf).orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"], "o_orderstatus", ["F", "O", "P"], "n")


@query("""select l_orderkey, l_linenumber, l_partkey, metric, value from (unpivot (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax from lineitem) on l_quantity, l_tax into name metric value value)""")
def unpivot_long(spark, sf):
    return A.unpivot(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_tax"], "metric", "value")


@query("""select code, count(*) as n from (select unnest(string_split(r, ';')) as code from (select concat_ws(';', case when l_discount > 0.05 then 'discounted' end, case when l_tax = 0 then 'untaxed' end, case when l_quantity > 40 then 'bulk' end) as r from lineitem) where r <> '') group by code""")
def explode_regroup(spark, sf):
    r = F.concat_ws(";", F.when(F.col("l_discount") > 0.05, "discounted"), F.when(F.col("l_tax") == 0, "untaxed"), F.when(F.col("l_quantity") > 40, "bulk"))
    return A.exploded_counts(Tables(spark, sf).lineitem.select(r.alias("r")), "r")


@query("""select o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, chr(10) order by o_orderkey)) as cohort from orders group by o_custkey""")
def order_hash(spark, sf):
    return Tables(spark, sf).orders.groupBy("o_custkey").agg(A.ordered_hash(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"), F.col("o_orderkey")).alias("cohort"))


@query("""select l_returnflag, cast(floor(l_quantity / 5) as bigint) as bin, count(*) as n from lineitem group by 1, 2""")
def histogram_width(spark, sf):
    return A.histogram(Tables(spark, sf).lineitem, ["l_returnflag"], "l_quantity", 5)


@query("""with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as q2, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1)
 select l_returnflag, q1, q2, q3, min(v) filter (inside) as low, max(v) filter (inside) as high, count(*) filter (not inside) as outliers from (select l_returnflag, q1, q2, q3, l_extendedprice as v,
 l_extendedprice between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5 as inside from lineitem join q using (l_returnflag)) group by 1, 2, 3, 4""")
def boxplot_stats(spark, sf):
    return A.box_stats(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice")


@query("""select x, y, r from (select unnest([('l_quantity', 'l_quantity', corr(l_quantity, l_quantity)), ('l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice)), ('l_quantity', 'l_discount', corr(l_quantity, l_discount)),
 ('l_extendedprice', 'l_quantity', corr(l_extendedprice, l_quantity)), ('l_extendedprice', 'l_extendedprice', corr(l_extendedprice, l_extendedprice)), ('l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount)),
 ('l_discount', 'l_quantity', corr(l_discount, l_quantity)), ('l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice)), ('l_discount', 'l_discount', corr(l_discount, l_discount))]) as u from lineitem) t(u), lateral (select u[1] as x, u[2] as y, u[3] as r)""")
def corr_matrix(spark, sf):
    return correlations(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("""select l_returnflag, avg(l_extendedprice) as mean, stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)) as se, avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)) as low, avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)) as high from lineitem group by l_returnflag""")
def se_ci(spark, sf):
    x = F.col("l_extendedprice")
    return Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(F.avg(x).alias("mean"), A.standard_error(x).alias("se"), (F.avg(x) - 1.96 * A.standard_error(x)).alias("low"), (F.avg(x) + 1.96 * A.standard_error(x)).alias("high"))


@query(f"""with g as (select l_linestatus, avg(l_extendedprice) filter (l_returnflag = 'R') as mean_a, avg(l_extendedprice) filter (l_returnflag <> 'R') as mean_b, var_samp(l_extendedprice) filter (l_returnflag = 'R') as var_a,
 var_samp(l_extendedprice) filter (l_returnflag <> 'R') as var_b, count(*) filter (l_returnflag = 'R') as n_a, count(*) filter (l_returnflag <> 'R') as n_b from lineitem group by 1),
 w as (select l_linestatus, mean_a, mean_b, n_a, n_b, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) as t, pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) as df from g) select *, {student_p('t', 'df')} as p_value from w""")
def welch_t(spark, sf):
    return welch(Tables(spark, sf).lineitem, ["l_linestatus"], "l_extendedprice", F.col("l_returnflag") == "R")


@query(f"""with o as (select ln(o_totalprice) as v, o_orderdate < timestamp '1998-01-01' as pre, case when o_totalprice <= 200000 then 'entry' when o_totalprice <= 400000 then 'move_up' end as segment, c_mktsegment as market from orders join customer on o_custkey = c_custkey),
 s as (select 'overall' as grouping, 'all' as level, v, pre from o union all select 'segment', segment, v, pre from o where segment is not null union all select 'market', market, v, pre from o),
 g as (select grouping, level, count(*) filter (pre) as n_before, count(*) filter (not pre) as n_after, avg(v) filter (pre) as a, avg(v) filter (not pre) as b, var_samp(v) filter (pre) / count(*) filter (pre) as va, var_samp(v) filter (not pre) / count(*) filter (not pre) as vb from s group by all),
 t as (select *, (a - b) / sqrt(va + vb) as t, pow(va + vb, 2) / (va * va / (n_before - 1) + vb * vb / (n_after - 1)) as df from g), p as (select *, {student_p('t', 'df')} as p_value from t)
 select grouping, level, n_before, n_after, exp(a) as mean_before, exp(b) as mean_after, 100 * (exp(b - a) - 1) as percent_change, t, df, p_value, case when p_value < 0.001 then 'reject ***' when p_value < 0.01 then 'reject **' when p_value < 0.05 then 'reject *' else 'fail to reject' end as decision from p""")
def welch_groups(spark, sf):
    """Log prices before and after a date: all sales, by price segment without the highest, and by market."""
    t = Tables(spark, sf)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("log_price", F.log("o_totalprice"))
    segment = F.when(F.col("o_totalprice") <= 200_000, "entry").when(F.col("o_totalprice") <= 400_000, "move_up")
    return welch_table(o, "log_price", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), {"overall": F.lit("all"), "segment": segment, "market": F.col("c_mktsegment")})


@query("""select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10""")
def top10(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("""select 'all' as section, 'all' as grp, count(*) as n from customer union all select 'segment', c_mktsegment, count(*) from customer group by c_mktsegment union all select 'nation', n_name, count(*) from customer join nation on c_nationkey = n_nationkey group by n_name""")
def union_sections(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows by definition
    n = F.count(F.lit(1)).alias("n")
    everything = c.agg(n).select(F.lit("all").alias("section"), F.lit("all").alias("grp"), "n")
    by = [c.groupBy(F.col(k).alias("grp")).agg(n).select(F.lit(s).alias("section"), "grp", "n") for s, k in (("segment", "c_mktsegment"), ("nation", "n_name"))]
    return everything.unionByName(by[0]).unionByName(by[1])


@query("""select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier where s_acctbal > 5000""")
def set_intersect(spark, sf):
    t = Tables(spark, sf)
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("""select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000""")
def except_keys(spark, sf):
    t = Tables(spark, sf)
    return t.nation.select(F.col("n_nationkey").alias("k")).exceptAll(t.supplier.where("s_acctbal > 5000").select("s_nationkey").distinct()).distinct()


@query("""select c_nationkey as key, c_mktsegment as seg, null::double as bal from customer where c_acctbal < 0 union all select s_nationkey, null, s_acctbal from supplier""")
def union_by_name(spark, sf):
    t = Tables(spark, sf)
    a = t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True).select("key", "seg", "bal")
