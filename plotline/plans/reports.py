"""Queries of listing filters, bridges, diagnostics, checks and table data."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import expr as X
from plotline.operators import reports as R
from plotline.operators.aggs import exact_sum
from plotline.plans.registry import Tables, query


@query("""select o_orderkey, o_orderpriority from orders where o_orderstatus in ('F', 'O') and regexp_matches(o_orderpriority, 'URGENT|HIGH')""")
def listing_filter_text(spark, sf):
    return R.listings_by_region_text(Tables(spark, sf).orders, "o_orderstatus", "o_orderpriority", ["F", "O"], ["URGENT", "HIGH"]).select("o_orderkey", "o_orderpriority")


@query("""select o_orderkey from (select o_orderkey, o_orderpriority, nullif(o_orderstatus, 'P') as st from orders) where o_orderpriority in ('1-URGENT', '5-LOW') and st is not null""")
def listing_filter_complete(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderpriority", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("st"))
    return R.listings_complete(o, "o_orderpriority", ["1-URGENT", "5-LOW"], ["st"]).select("o_orderkey")


@query("""select c_custkey, n_name from customer join nation on 'NATION_' || c_nationkey = n_name where c_mktsegment = 'BUILDING' and c_acctbal > 0""")
def listing_filter_monthly(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.withColumn("n_name", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    return R.listings_monthly(c, kind=F.col("c_mktsegment") == "BUILDING", period=F.col("c_acctbal") > 0, dimension=t.nation.select("n_name"), on="n_name", keys=["c_custkey"]).select("c_custkey", "n_name")


_RULES = {"legacy": "year(o_orderdate) between 1995 and 1998", "eligible": "o_orderstatus <> 'P'", "zip": "o_orderpriority <> '4-NOT SPECIFIED'"}


@query("""select count(*) as rows, count(*) filter (year(o_orderdate) between 1995 and 1998) as after_legacy, count(*) filter (year(o_orderdate) between 1995 and 1998 and o_orderstatus <> 'P') as after_eligible,
 count(*) filter (year(o_orderdate) between 1995 and 1998 and o_orderstatus <> 'P' and o_orderpriority <> '4-NOT SPECIFIED') as after_zip from orders""")
def bridge_audit(spark, sf):
    return R.bridge(Tables(spark, sf).orders, {k: F.expr(v) for k, v in _RULES.items()})[1]


@query("""select o_orderkey as sdf_id, year(o_orderdate) as data_year, strftime(o_orderdate, '%Y-%m-%d') as sale_date, o_totalprice as sale_price from orders where year(o_orderdate) between 1995 and 1998 and o_orderstatus <> 'P' and o_orderpriority <> '4-NOT SPECIFIED'""")
def bridge_rows(spark, sf):
    rows = R.bridge(Tables(spark, sf).orders, {k: F.expr(v) for k, v in _RULES.items()})[0]
    return rows.select(F.col("o_orderkey").alias("sdf_id"), F.year("o_orderdate").cast("long").alias("data_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"), F.col("o_totalprice").alias("sale_price"))


@query("""select c_nationkey, count(*) as cells, count(distinct m) as months, count(*) = 80 and count(distinct m) = 80 as balanced from (select distinct c_nationkey, date_trunc('month', o_orderdate) as m from orders join customer on o_custkey = c_custkey) group by 1""")
def panel_balance(spark, sf):
    t = Tables(spark, sf)
    p = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.trunc("o_orderdate", "month").alias("m")).distinct()
    return R.panel_balance(p, ["c_nationkey"], "m", 80)


@query("""with j as (select c_custkey, s_suppkey, n_nationkey from customer left join supplier on c_custkey = s_suppkey left join nation on c_nationkey = n_nationkey and n_regionkey <> 2)
 select 'supplier' as source, count(s_suppkey) as matched, count(*) - count(s_suppkey) as unmatched from j union all select 'nation', count(n_nationkey), count(*) - count(n_nationkey) from j""")
def join_diagnostics(spark, sf):
    t = Tables(spark, sf)
    j = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"), "left").join(t.nation.where("n_regionkey <> 2"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return R.join_diagnostics(j, {"supplier": "s_suppkey", "nation": "n_nationkey"})


@query("""select l_returnflag, count(*) filter (a is not null and b is not null) as strict, count(*) as n from (select l_returnflag, nullif(l_linestatus, 'F') as a, nullif(l_tax, 0) as b from lineitem) group by 1""")
def strict_availability(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_returnflag", F.nullif(F.col("l_linestatus"), F.lit("F")).alias("a"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("b"))
    return li.groupBy("l_returnflag").agg(F.count_if(R.strict_availability(["a", "b"])).alias("strict"), F.count(F.lit(1)).alias("n"))


@query("""select y, coalesce(a, 0) as store_rows, coalesce(b, 0) as funnel_rows, coalesce(a, 0) = coalesce(b, 0) as equal from (select year(o_orderdate) as y, count(*) as a from orders where o_orderstatus <> 'P' group by 1)
 full join (select year(o_orderdate) as y, count(*) as b from orders where year(o_orderdate) > 1995 group by 1) using (y)""")
def store_funnel_bridge(spark, sf):
    o = Tables(spark, sf).orders.withColumn("y", F.year("o_orderdate").cast("long"))
    a = o.where("o_orderstatus <> 'P'").groupBy("y").agg(F.count(F.lit(1)).alias("store_rows"))
    b = o.where("y > 1995").groupBy("y").agg(F.count(F.lit(1)).alias("funnel_rows"))
    return R.store_bridge(a, b, "y")


@query("""select 'prices_positive' as name, bool_and(o_totalprice > 0) as passed, count(*) as rows from orders union all select 'dates_in_window', bool_and(year(o_orderdate) < 2000), count(*) from orders union all select 'lines_have_orders', bool_and(l_orderkey in (select o_orderkey from orders)), count(*) from lineitem""")
def reconcile_checks(spark, sf):
    t = Tables(spark, sf)
    orders = t.orders.select("o_orderkey", (F.col("o_totalprice") > 0).alias("positive"), (F.year("o_orderdate") < 2000).alias("window"))
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("_m")), "l_orderkey", "left").select(F.col("_m").isNotNull().alias("known"))
    return R.checks({"prices_positive": (orders, "positive"), "dates_in_window": (orders, "window"), "lines_have_orders": (lines, "known")})


@query("""with r as (select o_orderpriority, case when year(o_orderdate) <= 1996 then 'BASELINE' when year(o_orderdate) <= 1998 then 'TRANSITION' else 'SHOCK' end as regime, o_totalprice from orders),
 g as (select o_orderpriority, regime, avg(o_totalprice) as mean from r group by 1, 2) select o_orderpriority, regime, mean, mean / avg(case when regime = 'BASELINE' then mean end) over (partition by o_orderpriority) * 100 as index from g""")
def regime_index(spark, sf):
    eras = (("BASELINE", 0, 1996), ("TRANSITION", 1997, 1998), ("SHOCK", 1999, 9999))
    o = Tables(spark, sf).orders.withColumn("regime", X.regime(F.year("o_orderdate"), eras))
    return R.regime_index(o, ["o_orderpriority"], "regime", "o_totalprice", "BASELINE")


@query("""select c_mktsegment, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,4))) as double) / count(*) as mean, stddev_samp(o_totalprice) as sd, median(o_totalprice) as median, min(o_totalprice) as lo, max(o_totalprice) as hi,
 count(distinct o_custkey) as parties, quantile_cont(o_totalprice, 0.05) as p05, quantile_cont(o_totalprice, 0.95) as p95 from orders join customer on o_custkey = c_custkey group by 1""")
def table1_summary(spark, sf):
    t = Tables(spark, sf)
    p = F.col("o_totalprice")
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), (exact_sum(p) / F.count(F.lit(1))).alias("mean"), F.stddev_samp(p).alias("sd"), F.median(p).alias("median"), F.min(p).alias("lo"), F.max(p).alias("hi"),
        F.count_distinct("o_custkey").alias("parties"), F.percentile(p, F.lit(0.05)).alias("p05"), F.percentile(p, F.lit(0.95)).alias("p95"),
    )


@query("""select l_shipdate::date::varchar as day, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as total, cast(sum(cast(l_extendedprice as decimal(18,4))) filter (l_discount >= 0.05) as double) as discounted from lineitem where l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1999-01-01' group by 1""")
def daily_volume(spark, sf):
    li = Tables(spark, sf).lineitem.where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    p = F.col("l_extendedprice")
    return li.groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), exact_sum(p).alias("total"), exact_sum(F.when(F.col("l_discount") >= 0.05, p)).alias("discounted"))
