"""Queries of window and time-series operators, and of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import windows as W
from plotline.operators.aggs import exact_sum
from plotline.plans.registry import Tables, query
from plotline.streaming.ingest import latest_by_event_time, run_once, tumbling_counts


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_type desc, event_id desc) as k from events) where k = 1""")
def latest_wins(spark, sf):
    return W.latest(Tables(spark, sf).events, ["user_id"], [F.desc("ts"), F.desc("event_type"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""select event_id, strftime(min(ts) over (partition by user_id), '%Y-%m-%d') as first_day from events""")
def min_over(spark, sf):
    from pyspark.sql import Window

    return Tables(spark, sf).events.select("event_id", F.date_format(F.min("ts").over(Window.partitionBy("user_id")), "yyyy-MM-dd").alias("first_day"))


@query("""select event_id, case when k = 1 then 'first_seen' when p is not distinct from event_type then 'repeat_identical' else 'repeat_revised' end as change from (select event_id, event_type, row_number() over w as k, lag(event_type) over w as p from events window w as (partition by user_id order by ts nulls last, event_id))""")
def lag_classify(spark, sf):
    return W.classify_repeats(Tables(spark, sf).events, "user_id", "event_type", [F.asc_nulls_last("ts"), F.asc("event_id")]).select("event_id", "change")




@query(f"""select day::varchar as day, gap_days, case when gap_days is null then 'first' when gap_days = 0 then 'same_day' when gap_days > 3 then 'probable_missing' when gap_days > 1 then 'delayed' else 'normal' end as gap_class
 from (select day, date_diff('day', lag(day) over (order by day), day)::int as gap_days from (select distinct cast(ts as date) as day from events))""")
def gap_classify(spark, sf):
    days = Tables(spark, sf).events.select(F.to_date("ts").alias("day")).distinct()
    return W.classify_gaps(days, "day", 1, 3).withColumn("day", F.col("day").cast("string"))


@query("""select event_id, case when count(value) over w >= 3 then median(value) over w end as med from events window w as (partition by user_id order by event_id rows between 4 preceding and 4 following)""")
def rolling_median9(spark, sf):
    return W.rolling_median(Tables(spark, sf).events, ["user_id"], "event_id", "value", 4, 3, "med").select("event_id", "med")


_MONTHLY = """(select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as total from orders group by 1, 2)"""


def _monthly(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(exact_sum(F.col("o_totalprice")).alias("total"))


@query(f"""select month, o_orderpriority, case when count(total) over w = 3 then avg(total) over w end as smooth from {_MONTHLY} window w as (partition by o_orderpriority order by month rows between 1 preceding and 1 following)""")
def rolling_mean3(spark, sf):
    return W.rolling_mean(_monthly(spark, sf), ["o_orderpriority"], "month", "total", "smooth").select("month", "o_orderpriority", "smooth")


@query(f"""select month, o_orderpriority, lag(total, 3) over w as total_lag3, lag(total, 6) over w as total_lag6 from {_MONTHLY} window w as (partition by o_orderpriority order by month)""")
def lag3_lag6(spark, sf):
    return W.lags(_monthly(spark, sf), ["o_orderpriority"], "month", "total", [3, 6]).drop("total")


@query(f"""with m as (select month, case when substr(month, 6) not in ('04', '09', '10') then total end as total, row_number() over (order by month) as p from {_MONTHLY} where o_orderpriority = '1-URGENT'),
 f as (select *, max(case when total is not null then p end) over (order by p rows between unbounded preceding and current row) as pa, min(case when total is not null then p end) over (order by p rows between current row and unbounded following) as pb from m)
 select f.month, coalesce(f.total, a.total + (b.total - a.total) * (f.p - f.pa) / (f.pb - f.pa)) as total, f.total is null and a.total is not null and b.total is not null as imputed from f left join m a on f.pa = a.p left join m b on f.pb = b.p""")
def interp_interior(spark, sf):
    m = _monthly(spark, sf).where("o_orderpriority = '1-URGENT'")
    m = m.select("month", F.when(~F.substring("month", 6, 2).isin("04", "09", "10"), F.col("total")).alias("total"))
    return W.interpolate(m, "month", "total")


@query("""with s as (select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as m from orders)
 select strftime(m, '%Y-%m') as month, coalesce(n, 0) as n from s left join (select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by 1) using (m)""")
def date_spine(spark, sf):
    o = Tables(spark, sf).orders
    b = o.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    facts = o.groupBy(F.trunc("o_orderdate", "month").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))
    s = W.month_spine(spark, F.col("a"), F.col("b"), b).join(facts, "month_start", "left")
    return s.select(F.date_format("month_start", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""with y as (select o_orderpriority, year(o_orderdate) as y, cast(sum(cast(o_totalprice as decimal(18,4))) as double) as total from orders group by 1, 2) select o_orderpriority, y, total / avg(case when y = 1997 then total end) over (partition by o_orderpriority) * 100 as index from y""")
def index_to_base(spark, sf):
    y = Tables(spark, sf).orders.groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(exact_sum(F.col("o_totalprice")).alias("total"))
    return W.index_to_base(y, ["o_orderpriority"], "total", F.col("y") == 1997, "index").drop("total")


@query("""select c_custkey, dense_rank() over (order by c_mktsegment) as seg_id from customer""")
def dense_factor_id(spark, sf):
    return W.dense_ids(Tables(spark, sf).customer, "c_mktsegment", "seg_id").select("c_custkey", F.col("seg_id").cast("long").alias("seg_id"))


@query("""select c_custkey, coalesce(b, m) as bal from (select c_custkey, c_nationkey, nullif(greatest(c_acctbal, 0), 0) as b from customer) join (select c_nationkey, median(nullif(greatest(c_acctbal, 0), 0)) as m from customer group by 1) using (c_nationkey)""")
def group_median_impute(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_nationkey", F.nullif(F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0)).alias("b"))
    return W.impute_median(c, ["c_nationkey"], "b", "bal").select("c_custkey", "bal")


@query("""select o_orderkey, greatest(-8, least(4, (year(o_orderdate) - 1998) * 4 + quarter(o_orderdate) - 1)) as event_quarter from orders""")
def clamp_quarter(spark, sf):
    q = (F.year("o_orderdate") - 1998) * 4 + F.quarter("o_orderdate") - 1
    return Tables(spark, sf).orders.select("o_orderkey", W.clamp(q, -8, 4).cast("long").alias("event_quarter"))


def _stream(spark, sf):
    static = spark.read.parquet(f"{sf}/events.parquet")
    # a file stream reads a folder; the table may be one file
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query("""select user_id, count(*) as versions, arg_max(event_type, (ts, event_id)) as event_type, max(event_id) filter (k = 1) as event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) group by user_id""")
def stream_latest_wins(spark, sf):
    return run_once(latest_by_event_time(_stream(spark, sf), "user_id", ["ts", "event_id"], ["event_type"])).select("user_id", "versions", "event_type", "event_id")


@query("""select strftime(time_bucket(interval 7 days, ts, timestamp '2023-12-28'), '%Y-%m-%d') as bucket, event_type, count(*) as n from events group by 1, 2""")
def stream_tumbling(spark, sf):
    out = run_once(tumbling_counts(_stream(spark, sf), "ts", "7 days", ["event_type"]))
    return out.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "event_type", "n")
