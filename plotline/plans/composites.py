"""Queries of the composite operators: dispositions, panels, prices, versions, contracts, XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import expr as X
from plotline.operators import aggs as A
from plotline.operators import contract as C
from plotline.operators import dedup as D
from plotline.operators import joins as J
from plotline.operators import panel as P
from plotline.operators import versions as V
from plotline.operators import xml_records as XML
from plotline.operators.windows import latest
from plotline.plans.registry import Tables, query

_DISPOSED = """with e as (select event_id, case when event_type <> 'error' then user_id || ':' || cast(ts as date) || ':' || cast(floor(value / 40) as int) end as key, event_type as st, floor(value / 20) as core from events),
 g as (select key, count(*) as n, count(distinct core) as cores, count(distinct (core, st)) as alls from e where key is not null group by key),
 d as (select e.*, case when e.key is null then 'invalid_key' when n = 1 then 'unique' when alls = 1 then 'exact' when cores = 1 then 'status_variant' else 'conflict' end as disposition, row_number() over (partition by e.key order by event_id desc) as k from e left join g using (key))
"""


def _disposed(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("event_type") != "error", F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"), F.floor(F.col("value") / 40).cast("int").cast("string"))).alias("key"), F.col("event_type").alias("st"), F.floor(F.col("value") / 20).alias("core"))
    return D.dispositions(e, key="key", core=["core"], status=["st"], prefer=[F.desc("event_id")])


@query(_DISPOSED + "select event_id, disposition, disposition in ('unique', 'exact', 'status_variant') and k = 1 as kept from d")
def dedup_disposition(spark, sf):
    return _disposed(spark, sf).select("event_id", "disposition", "kept")


@query(_DISPOSED + """select st, count(*) as raw, count(*) filter (disposition = 'invalid_key') as invalid, count(*) filter (disposition = 'exact' and k > 1) as exact, count(*) filter (disposition = 'status_variant' and k > 1) as variant,
 count(*) filter (disposition = 'conflict') as conflicting, count(*) filter (disposition in ('unique', 'exact', 'status_variant') and k = 1) as kept, true as balanced from (select d.*, event_type as st0 from d join events using (event_id)) group by st""")
def funnel_reconcile(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.col("event_type").alias("kind"))
    d = _disposed(spark, sf).drop("st").join(e, "event_id").withColumnRenamed("kind", "st")
    return D.funnel(d, ["st"])


@query(_DISPOSED + """select key, case disposition when 'invalid_key' then 'invalid_transaction_key' when 'exact' then 'exact_duplicate_collapsed' when 'status_variant' then 'status_variant_collapsed' else 'conflicting_duplicate' end as issue_code,
 case disposition when 'exact' then 'info' when 'status_variant' then 'warning' else 'error' end as severity, count(*) as rows from d where disposition in ('invalid_key', 'conflict') or (disposition in ('exact', 'status_variant') and k > 1) group by 1, 2, 3""")
def quality_event_log(spark, sf):
    return D.quality_events(_disposed(spark, sf), "key")


_INDEX = """i as (select date_trunc('month', o_orderdate) as m, 100.0::double + count(*) as cpi from orders group by 1), b as (select avg(cpi) as base from i where year(m) = 1997)"""


def _cpi(t):
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("month_start")).agg((F.lit(100.0) + F.count(F.lit(1))).alias("cpi"))


@query(f"""with {_INDEX} select o_orderkey, o_totalprice * base / cpi as real_price from orders join i on date_trunc('month', o_orderdate) = m cross join b""")
def real_price(spark, sf):
    t = Tables(spark, sf)
    sales = t.orders.withColumn("month", F.trunc("o_orderdate", "month"))
    return P.real_price(sales, P.monthly_index(_cpi(t), "month_start", "cpi"), price="o_totalprice", month="month", value="cpi", base_year=1997).select("o_orderkey", "real_price")


@query("""select strftime(o_orderdate, '%Y-%m') as month, median(o_totalprice) as price, 3.0::double + month(o_orderdate) / 4.0::double as rate, median(o_totalprice) * 0.8::double * ((3.0::double + month(o_orderdate) / 4.0::double) / 1200.0::double) * pow(1 + (3.0::double + month(o_orderdate) / 4.0::double) / 1200.0::double, 360)
 / (pow(1 + (3.0::double + month(o_orderdate) / 4.0::double) / 1200.0::double, 360) - 1) as payment from orders group by 1, month(o_orderdate)""")
def payment_by_month(spark, sf):
    o = Tables(spark, sf).orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    macro = o.select("month", (F.lit(3.0) + F.month("o_orderdate") / F.lit(4.0)).alias("rate")).distinct()
    g = A.quantiles(o, ["month"], "o_totalprice", {"price": 0.5})
    return J.join_n1(g, macro, ["month"]).select("month", "price", "rate", X.payment(F.col("price"), F.col("rate")).alias("payment"))


@query("""select c_nationkey as zip, o_orderstatus as county, count(*) as transactions, median(o_totalprice) as median_price, count(*) filter (o_totalprice > 200000 and o_totalprice <= 400000) * 100.0::double / count(*) as pct_mid,
 max(n_name) as name, median(o_totalprice) * 12 / 1000000.0::double > 2.9 as stressed from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by 1, 2 having count(*) >= 10""")
def zip_summary(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    mid = P.tier(F.col("o_totalprice"), [200_000, 400_000], ["entry", "mid", "luxury"]) == "mid"
    g = j.groupBy(F.col("c_nationkey").alias("zip"), F.col("o_orderstatus").alias("county")).agg(F.count(F.lit(1)).alias("transactions"), F.median("o_totalprice").alias("median_price"), (F.count_if(mid) * F.lit(100.0) / F.count(F.lit(1))).alias("pct_mid")).where("transactions >= 10")
    g = J.join_n1(g, t.nation.select(F.col("n_nationkey").alias("zip"), F.col("n_name").alias("name")), ["zip"])
    return g.select("zip", "county", "transactions", "median_price", "pct_mid", "name", (F.col("median_price") * 12 / 1000000.0 > 2.9).alias("stressed"))


#: Nations by month (and tier): fine enough for cells without a sale.
_GRID = """months as (select distinct date_trunc('month', o_orderdate) as m from orders), facts as (select n_nationkey, date_trunc('month', o_orderdate) as m, {0} count(*) as transactions, median(o_totalprice) as price from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""


def _facts(t, *more):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey", F.trunc("o_orderdate", "month").alias("m"), *more).agg(F.count(F.lit(1)).alias("transactions"), F.median("o_totalprice").alias("price"))


@query(f"""with {_GRID.format('')} select n_name, strftime(months.m, '%Y-%m') as month, coalesce(transactions, 0) as transactions, price, price is not null as observed from nation cross join months left join facts on nation.n_nationkey = facts.n_nationkey and facts.m = months.m""")
def county_month_panel(spark, sf):
    t = Tables(spark, sf)
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    p = P.balanced_panel(_facts(t), [t.nation, months], ["n_nationkey", "m"], ["transactions"])
    return p.select("n_name", F.date_format("m", "yyyy-MM").alias("month"), "transactions", "price", F.col("price").isNotNull().alias("observed"))


@query(f"""with {_GRID.format("case when o_totalprice <= 200000 then 'entry' when o_totalprice <= 400000 then 'mid' else 'luxury' end as tier,")}, tiers as (select unnest(['entry', 'mid', 'luxury']) as tier)
 select n_name, strftime(months.m, '%Y-%m') as month, tiers.tier, coalesce(transactions, 0) as transactions, price from nation cross join months cross join tiers left join facts on nation.n_nationkey = facts.n_nationkey and facts.m = months.m and facts.tier = tiers.tier""")
def tier_panel_zero_fill(spark, sf):
    t = Tables(spark, sf)
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("m")).distinct()
    tiers = t.nation.select(F.explode(F.array(*[F.lit(x) for x in ("entry", "mid", "luxury")])).alias("tier")).distinct()
    facts = _facts(t, P.tier(F.col("o_totalprice"), [200_000, 400_000], ["entry", "mid", "luxury"]).alias("tier"))
    p = P.balanced_panel(facts, [t.nation, months, tiers], ["n_nationkey", "m", "tier"], ["transactions"])
    return p.select("n_name", F.date_format("m", "yyyy-MM").alias("month"), "tier", "transactions", "price")


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_extendedprice <= 407000.0 / 10 then 'entry' when l_extendedprice <= 1097000.0 / 12 then 'mid' else 'luxury' end as tier from lineitem""")
def tier_boundaries_apply(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey", P.tier(F.col("l_extendedprice"), [407000.0 / 10, 1097000.0 / 12], ["entry", "mid", "luxury"]).alias("tier"))


#: Every split of the sorted cells into three, by its cost: sums of squares within.
_FIT = """x as (select {by} as g, {x} as x from {table}), e as (select g, min(x) as lo, max(x) as hi from x group by 1),
 c as (select g, least(floor((x - lo) / (hi - lo) * {bins}), {bins} - 1) as c, count(*) as n, cast(sum(cast(x as decimal(18,9))) as double) as s from x join e using (g) group by 1, 2),
 p as (select g, row_number() over w as i, sum(n) over w as n, sum(s) over w as s, sum(s * s / n) over w as q from c window w as (partition by g order by c)), t as (select g, max(i) as k, max_by(n, i) as n, max_by(s, i) as s, max_by(q, i) as q from p group by 1),
 a as (select g, arg_min([a.s / a.n, (b.s - a.s) / (b.n - a.n), (t.s - b.s) / (t.n - b.n)], a.q - a.s * a.s / a.n + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) + (t.q - b.q) - (t.s - b.s) * (t.s - b.s) / (t.n - b.n)) as m, any_value(t.n) as n
  from p a join p b using (g) join t using (g) where a.i < b.i and b.i < t.k group by 1)"""


@query(f"""with {_FIT.format(by='0', x='ln(l_extendedprice)', table='lineitem', bins=512)}, f as (select exp((m[1] + m[2]) / 2) as b1, exp((m[2] + m[3]) / 2) as b2 from a)
 select case when l_extendedprice <= b1 then 'entry' when l_extendedprice <= b2 then 'mid' else 'luxury' end as tier, count(*) as n, max(l_extendedprice) as top from lineitem cross join f group by 1""")
def tier_fit(spark, sf):
    """Boundaries fitted on log prices, and the rows of each tier."""
    li = Tables(spark, sf).lineitem
    b = P.tier_breaks(li, "l_extendedprice", bins=512)
    return li.groupBy(P.tier(F.col("l_extendedprice"), b, ["entry", "mid", "luxury"]).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top"))


_LINE = "o_orderkey::varchar || '|' || printf('%.10f', o_totalprice)"


@query(f"""with {_FIT.format(by='o_orderstatus', x='ln(o_totalprice)', table='orders', bins=256)}, q as (select o_orderstatus as g, quantile_cont(o_totalprice, 1/3) as lower_tertile, quantile_cont(o_totalprice, 2/3) as upper_tertile from orders group by 1),
 h as (select g, sha256(string_agg(h, chr(10) order by b)) as cohort from (select o_orderstatus as g, md5(o_orderkey::varchar)[1:3] as b, sha256(string_agg({_LINE}, chr(10) order by o_orderkey, {_LINE})) as h from orders group by 1, 2) group by 1)
 select g as o_orderstatus, n::bigint as n, exp((m[1] + m[2]) / 2) as entry_boundary, exp((m[2] + m[3]) / 2) as high_end_boundary, lower_tertile, upper_tertile, cohort from a join q using (g) join h using (g)""")
def tier_fit_by_group(spark, sf):
    """Each group's own boundaries, tertiles and the digest of the sales they were fitted on."""
    return P.tier_breaks_by(Tables(spark, sf).orders, "o_totalprice", "o_orderstatus", key="o_orderkey", least=100, bins=256)


_RAW_FIT = """x as (select o_totalprice as x from orders where o_totalprice <= 450000), e as (select min(x) as lo, max(x) as hi from x),
 c as (select least(floor((x - lo) / (hi - lo) * 64), 63) as c, count(*) as n, cast(sum(cast(x as decimal(18,9))) as double) as s from x cross join e group by 1),
 p as (select row_number() over w as i, sum(n) over w as n, sum(s) over w as s, sum(s * s / n) over w as q from c window w as (order by c)), t as (select * from p order by i desc limit 1),
 m as (select arg_min([a.s / a.n, (b.s - a.s) / (b.n - a.n), (d.s - b.s) / (d.n - b.n)], a.q - a.s * a.s / a.n + (b.q - a.q) - (b.s - a.s) * (b.s - a.s) / (b.n - a.n) + (d.q - b.q) - (d.s - b.s) * (d.s - b.s) / (d.n - b.n) + (t.q - d.q) - (t.s - d.s) * (t.s - d.s) / (t.n - d.n)) as m
  from p a join p b on a.i < b.i join p d on b.i < d.i join t on d.i < t.i)"""


@query(f"""with {_RAW_FIT}, f as (select (m[1] + m[2]) / 2 as b1, (m[2] + m[3]) / 2 as b2 from m)
 select case when o_totalprice <= b1 then 'entry' when o_totalprice <= b2 then 'move_up' else 'luxury' end as tier, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as top from orders cross join f group by 1""")
def raw_tier_fit(spark, sf):
    """Three tiers from four clusters of raw prices up to a cap; prices above it are in the highest."""
    o = Tables(spark, sf).orders
    b = P.raw_tier_breaks(o, "o_totalprice", cap=450_000, bins=64)
    return o.groupBy(P.tier(F.col("o_totalprice"), b, ["entry", "move_up", "luxury"]).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("top"))


_INCOME = "with y as (select c_nationkey as county, year(o_orderdate) as y, count(*) as income from orders join customer on o_custkey = c_custkey group by 1, 2)"


_VINTAGE = """select county, y, income, false as carried, '{1}' as vintage from y where y <> 2001 or (select count(*) from y where y = 2001) = {0} union all select county, 2001, income, true, '{1}' from y where y = 2000 and (select count(*) from y where y = 2001) <> {0}"""


@query(f"{_INCOME} {_VINTAGE.format(25, 'complete')} union all {_VINTAGE.format(26, 'short')}")
def income_carry_forward(spark, sf):
    """The last year's vintage where all counties are in it (25), and where one is wanting (26)."""
    t = Tables(spark, sf)
    y = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("county"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("income"))
    return P.carry_vintage(y, "y", 2001, 25).withColumn("vintage", F.lit("complete")).unionByName(P.carry_vintage(y, "y", 2001, 26).withColumn("vintage", F.lit("short")))


@query("""select year(o_orderdate) as y, count(distinct cast(o_orderdate as date)) as units, count(distinct cast(o_orderdate as date)) >= 300 as covered from orders group by 1""")
def source_coverage(spark, sf):
    o = Tables(spark, sf).orders.select(F.year("o_orderdate").cast("long").alias("y"), F.to_date("o_orderdate").alias("d"))
    return P.coverage(o, "y", "d", 300)


@query("""select strftime(cast(ts as date), '%Y-%m') as month, avg(value) as rate from (select date_trunc('week', ts) as ts, median(value) as value from events group by 1) group by 1""")
def weekly_to_monthly(spark, sf):
    w = Tables(spark, sf).events.groupBy(F.date_trunc("week", "ts").alias("ts")).agg(F.median("value").alias("value"))
    return w.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.avg("value").alias("rate"))


@query("""with o as (select user_id as key, cast(ts as date) as x, event_type, event_id from events), c as (select key, x from o group by 1, 2 having count(distinct event_type) > 1),
 t as (select *, min(x) over (partition by key) as first_extract, row_number() over (partition by key order by x desc, event_id desc) as k from o)
 select t.key, t.event_id, first_extract::varchar as first_extract, c.key is not null as revision_conflict from t left join c on t.key = c.key and t.x = c.x where k = 1""")
def current_view_conflict(spark, sf):
    o = Tables(spark, sf).events.select(F.col("user_id").alias("key"), F.to_date("ts").alias("x"), "event_type", "event_id")
    v = V.current_view(o, key="key", extract="x", content="event_type", order=[F.desc("x"), F.desc("event_id")])
    return v.select("key", "event_id", F.col("first_extract").cast("string").alias("first_extract"), "revision_conflict")


@query("""with p as (select user_id, count(*) as n, arg_min(event_type, (ts, event_id)) as a1, arg_max(event_type, (ts, event_id)) as b1, arg_min(props, (ts, event_id)) as a2, arg_max(props, (ts, event_id)) as b2 from events group by 1 having count(*) > 1)
 select user_id, unnest(case when len(f) = 0 then ['unexplained'] else list_append(f, 'any_revision') end) as field from (select user_id, list_filter([case when a1 is distinct from b1 then 'event_type' end, case when a2 is distinct from b2 then 'props' end], lambda x: x is not null) as f from p)""")
def revision_fields(spark, sf):
    pairs = J.first_and_last(Tables(spark, sf).events, "user_id", [F.col("ts"), F.col("event_id")], ["event_type", "props"])
    return V.revised_fields(pairs, "user_id", ["event_type", "props"])


@query("""select l_orderkey, 'child_lines' as field from (select l_orderkey, coalesce(list(l_linestatus order by l_linenumber, l_linestatus) filter (l_returnflag = 'A'), []) as a, coalesce(list(l_linestatus order by l_linenumber, l_linestatus) filter (l_returnflag = 'R'), []) as b
 from lineitem where l_returnflag in ('A', 'R') group by 1) where a <> b""")
def child_revisions(spark, sf):
    return V.revised_children(Tables(spark, sf).lineitem, "l_orderkey", "l_returnflag", "l_linenumber", F.col("l_linestatus"), "A", "R", "lines")


@query("""select strftime(ts, '%Y-%m-%d') as day, count(*) as members, count(*) filter (event_type <> 'error') as valid, count(*) filter (event_type = 'error') as quarantined, true as balanced from events group by 1""")
def extract_year_accounting(spark, sf):
    e = Tables(spark, sf).events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") != "error").alias("ok"))
    out = V.accounting(e, e.where("ok"), e.where("not ok"), "day", valid="ok")
    return out.select("day", "members", "valid", "quarantined", "balanced")


@query("""select sha256('1.1.0' || chr(10) || string_agg(h, chr(10) order by h)) as snapshot from (select distinct md5(source) as h from documents)""")
def snapshot_hash(spark, sf):
    return V.snapshot_hash(Tables(spark, sf).documents.select(F.md5("source").alias("h")), "h", "1.1.0")


@query("""select l_partkey, l_suppkey from lineitem where l_returnflag = 'R' group by 1, 2 having not bool_or((l_partkey, l_suppkey) in (select (l_partkey, l_suppkey) from lineitem where l_returnflag = 'A'))""")
def insert_or_ignore(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return V.insert_or_ignore(li.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), li.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"])


@query("""select l_orderkey, l_linenumber, l_partkey, case when net > 0 then net end as adjusted from (select *, l_extendedprice - (case when l_returnflag = 'A' then case when l_discount > 0.01 then l_extendedprice * l_discount end when l_returnflag = 'R' then 0.0::double end) - nullif(l_tax, 0) * 40000 as net from lineitem)""")
def adjusted_price(spark, sf):
    li = Tables(spark, sf).lineitem
    included = F.when(F.col("l_returnflag") == "A", F.lit(True)).when(F.col("l_returnflag") == "R", F.lit(False))
    net = C.adjusted_price(F.col("l_extendedprice"), F.nullif(F.col("l_tax"), F.lit(0.0)) * 40000, included, F.col("l_extendedprice") * F.col("l_discount"), F.col("l_discount") > 0.01)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", net.alias("adjusted"))


@query("""with d as (select o_orderkey, cast(o_orderdate as date) as sale, cast(l_shipdate as date) as seen, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lag from orders join (select l_orderkey, min(l_shipdate) as l_shipdate from lineitem group by 1) on o_orderkey = l_orderkey),
 r as (select lag, row_number() over (order by lag) - 1 as k, count(*) over () as n from d where lag >= 0), m as (select max(case when k = ceil((n - 1) * 0.95) then lag end) as maturity from r)
 select o_orderkey, lag::int as lag_days, maturity::int as maturity_days, sale > (select max(seen) from d) - maturity::int as recent from d cross join m""")
def report_lag_maturity(spark, sf):
    t = Tables(spark, sf)
    seen = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("date").alias("seen"))
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("sale")).join(seen, "o_orderkey")
    return C.reporting(d, key="o_orderkey", sale_date="sale", first_extract="seen").select("o_orderkey", "lag_days", "maturity_days", "recent")


@query("""select o_orderpriority, code, count(*) as n from (select o_orderpriority, unnest(string_split(r, ';')) as code from (select o_orderpriority, concat_ws(';', case when o_totalprice <= 100000 then 'price_at_or_below_floor' end, case when o_orderstatus = 'P' then 'status_pending' end, case when year(o_orderdate) < 1996 then 'before_window' end) as r from orders) where r <> '') group by 1, 2""")
def explode_exclusions(spark, sf):
    rules = [("price_at_or_below_floor", F.col("o_totalprice") <= 100000), ("status_pending", F.col("o_orderstatus") == "P"), ("before_window", F.year("o_orderdate") < 1996)]
    o = Tables(spark, sf).orders.select("o_orderpriority", X.reasons(rules, False).alias("r")).where("r <> ''")
    return o.select("o_orderpriority", F.explode(F.split("r", ";")).alias("code")).groupBy("o_orderpriority", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""select l_orderkey, count(*) as uses, coalesce(bool_and(x), true) as all_single_family, string_agg(distinct e, ';' order by e) as evidence from (select l_orderkey, case when l_linestatus = 'F' then l_quantity < 30 end as x, case l_returnflag when 'A' then 'legacy' else 'modern' end as e from lineitem where l_linenumber <= 4) group by 1""")
def use_summary(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("timing", F.when(F.col("l_linenumber") <= 4, "before").otherwise("after"))
    return C.use_summary(li, "l_orderkey", "timing", "before", F.when(F.col("l_linestatus") == "F", F.col("l_quantity") < 30), F.when(F.col("l_returnflag") == "A", "legacy").otherwise("modern"))


@query("""select l_orderkey, count(*) as items, cast(sum(cast(v as decimal(18,4))) as double) as total, bool_and(coalesce(v >= 0, false)) as complete from (select l_orderkey, case when l_tax > 0 then l_extendedprice end as v from lineitem where l_returnflag = 'R') group by 1""")
def personal_property_summary(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("v", F.when(F.col("l_tax") > 0, F.col("l_extendedprice")))
    return C.personal_summary(li, "l_orderkey", F.col("l_returnflag") == "R", "v")


@query("""select o_orderkey, try_cast(o_orderpriority as bigint) as code, cast(o_totalprice as double) as price, cast(o_orderdate as date)::varchar as day from orders""")
def contract_coercion(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.col("o_orderpriority").alias("code"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return C.coerce(o, {"o_orderkey": "bigint", "code": "bigint", "price": "double", "day": "date"}).withColumn("day", F.col("day").cast("string"))


@query("""with s as (select c_nationkey as zip, c_mktsegment as county, count(*) as n, median(nullif(greatest(c_acctbal, 0), 0)) as income from customer group by 1, 2)
 select zip, cast(sum(cast(income * n as decimal(18,4))) as double) / cast(sum(cast(n as decimal(18,4))) as double) as income, arg_min(county, (-n, county)) as county, cast(sum(n) as bigint) as n from s where income is not null group by zip""")
def zip_map_aggregate(spark, sf):
    c = Tables(spark, sf).customer.groupBy(F.col("c_nationkey").alias("zip"), F.col("c_mktsegment").alias("county")).agg(F.count(F.lit(1)).alias("n"), F.median(F.nullif(F.greatest(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0))).alias("income")).where("income is not null")
    return c.groupBy("zip").agg(A.weighted_mean(F.col("income"), F.col("n").cast("double")).alias("income"), A.arg_max(F.col("county"), F.col("n")).alias("county"), F.sum("n").alias("n"))


def _members(spark, sf):
    """XML members made from the orders table, some of them broken the ways that recovery knows."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    form = F.format_string(
        "<ecrvForm><headerForm><countyCde>%02d</countyCde><crvNumberId>%d</crvNumberId></headerForm><propertyForm><parcels><id>%d</id></parcels></propertyForm><note>%s</note><salesAgreementForm><deedContractDate>%s</deedContractDate><totPurchaseAmt>%s</totPurchaseAmt></salesAgreementForm></ecrvForm>",
        (k % 90).cast("int"), k, F.col("o_custkey"), F.when(k % 11 == 0, F.lit("a&#11;b")).when(k % 13 == 0, F.lit("a & b")).otherwise(F.lit("ok")), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00"), F.when(k % 17 == 0, F.lit("")).otherwise(F.format_string("%.4f", F.col("o_totalprice"))),
    )
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("archive"), k.cast("int").alias("ordinal"), F.concat(F.lpad((k % 90).cast("string"), 2, "0"), F.lit("_"), k.cast("string"), F.lit(".xml")).alias("name"), F.length(form).cast("long").alias("bytes"), F.encode(form, "UTF-8").alias("content"))


@query("""select name, case when o_orderkey % 13 = 0 and o_orderkey % 11 <> 0 then 'malformed_xml' when o_orderkey % 90 not between 1 and 87 then 'invalid_transaction_key' when o_orderkey % 17 = 0 then 'missing_required_amount' else '' end as issue_code, o_orderkey % 11 = 0 as parse_recovered
 from (select o_orderkey, lpad(cast(o_orderkey % 90 as varchar), 2, '0') || '_' || o_orderkey || '.xml' as name from orders)""")
def xml_parse_recover(spark, sf):
    return XML.parse_members(_members(spark, sf)).select("name", "issue_code", "parse_recovered")


@query("""select disposition, count(*) as n from (select case when o_orderkey % 13 = 0 and o_orderkey % 11 <> 0 then 'malformed_xml' when o_orderkey % 90 not between 1 and 87 then 'invalid_transaction_key' when o_orderkey % 17 = 0 then 'missing_required_amount' else 'valid' end as disposition from orders) group by 1""")
def archive_dispositions(spark, sf):
    return XML.member_dispositions(XML.parse_members(_members(spark, sf))).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


_DISPOSITION = "case when o_orderkey % 13 = 0 and o_orderkey % 11 <> 0 then 'malformed_xml' when o_orderkey % 90 not between 1 and 87 then 'invalid_transaction_key' when o_orderkey % 17 = 0 then 'missing_required_amount' else 'valid' end"


@query(f"""select strftime(o_orderdate, '%Y-%m') as archive, count(*) as members, count(*) filter (d = 'valid') as valid, count(*) filter (d = 'valid' and o_orderkey % 11 = 0) as recovered, count(*) filter (d <> 'valid') as errors,
 case when count(*) filter (d <> 'valid') = 0 then 'complete' else 'incomplete' end as status from (select *, {_DISPOSITION} as d from orders) group by 1""")
def archive_status(spark, sf):
    return XML.batch_status(XML.member_dispositions(XML.parse_members(_members(spark, sf))))


@query(f"""select issue_code, severity, count(*) as n from (select case when d <> 'valid' then d when o_orderkey % 11 = 0 then 'parse_recovered' end as issue_code, case when d = 'valid' then 'warning' else 'error' end as severity from (select *, {_DISPOSITION} as d from orders)) where issue_code is not null group by 1, 2""")
def member_event_log(spark, sf):
    events = XML.member_events(XML.member_dispositions(XML.parse_members(_members(spark, sf))))
    return events.groupBy("issue_code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as archive, o_orderkey as k from orders where not (o_orderkey % 13 = 0 and o_orderkey % 11 <> 0)),
 p as (select unnest(['', '/headerForm', '/headerForm/countyCde', '/headerForm/crvNumberId', '/propertyForm', '/propertyForm/parcels', '/propertyForm/parcels/id', '/note', '/salesAgreementForm', '/salesAgreementForm/deedContractDate', '/salesAgreementForm/totPurchaseAmt']) as path)
 select archive, 'ecrvForm' || path as path, count(*) as present, count(*) filter (path not in ('', '/headerForm', '/propertyForm', '/propertyForm/parcels', '/salesAgreementForm') and not (path = '/salesAgreementForm/totPurchaseAmt' and k % 17 = 0)) as nonempty from m cross join p group by 1, 2""")
def xml_paths_audit(spark, sf):
    return XML.audit_paths(_members(spark, sf), "archive")


@query("""select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by (year(o_orderdate) = 1998) desc, o_orderdate desc, o_orderkey desc) as k from orders) where k = 1""")
def preferred_source_row(spark, sf):
    o = Tables(spark, sf).orders
    return latest(o, ["o_custkey"], [F.desc(F.year("o_orderdate") == 1998), F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")
