"""Queries of the row-level operators: projections, predicates, validation, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.functions import expr as X
from plotline.operators.aggs import exact_sum
from plotline.plans.registry import Tables, query


@query("""select flag, count(*) as n from (select case when upper(trim(left(o_orderstatus, 1))) in ('Y','YES','1','P') then true
 when upper(trim(left(o_orderstatus, 1))) in ('N','NO','0','F') then false end as flag from orders) group by flag""")
def flag_decode(spark, sf):
    mapped = F.replace(F.replace(F.substring("o_orderstatus", 1, 1), F.lit("P"), F.lit(" y ")), F.lit("F"), F.lit("no"))
    return Tables(spark, sf).orders.select(X.flag(mapped).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


_ZIP = """select zip, count(*) as n from (select case when p <> '00000' then p end as zip from (select case when regexp_full_match(s, '[0-9]{{3,5}}') then lpad(s, 5, '0') end as p
 from (select regexp_replace(split_part(trim(x), '-', 1), '{0}', '') as s from (select case p_partkey % 4 when 0 then '46' || (p_partkey % 900) || '-0001' when 1 then (p_partkey % 1000) || '.0'
 when 2 then (p_partkey % 7000) || '.000' else p_name end as x from part)))) group by zip"""


def _zips(spark, sf, zeros):
    k = F.col("p_partkey")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("46"), (k % 900).cast("string"), F.lit("-0001"))).when(k % 4 == 1, F.concat((k % 1000).cast("string"), F.lit(".0"))).when(k % 4 == 2, F.concat((k % 7000).cast("string"), F.lit(".000"))).otherwise(F.col("p_name"))
    return Tables(spark, sf).part.select(X.zip5(raw, zeros).alias("zip")).groupBy("zip").agg(F.count(F.lit(1)).alias("n"))


@query(_ZIP.format(r"\.0$"))
def zip_normalize(spark, sf):
    return _zips(spark, sf, False)


@query(_ZIP.format(r"\.0*$"))
def zip_normalize_zeros(spark, sf):
    return _zips(spark, sf, True)


@query("""select n_name as raw, trim(regexp_replace(upper(n_name || ' County '), '\\s*COUNTY\\s*$', '')) as county from nation""")
def county_normalize(spark, sf):
    return Tables(spark, sf).nation.select(F.col("n_name").alias("raw"), X.county_name(F.concat("n_name", F.lit(" County "))).alias("county"))


@query("""select count(*) filter (regexp_full_match(c, '5[1-9][0-9]')) as improved, count(*) filter (regexp_full_match(c, '51[0-5]')) as single_family, count(*) filter (regexp_full_match(c, '5[0-9]{2}')) as residential,
 count(*) filter (regexp_full_match(c, '[12][0-9]{2}')) as agricultural, count(*) filter (regexp_full_match(c, '4[0-9]{2}')) as commercial, count(*) filter (regexp_full_match(c, '3[0-9]{2}')) as industrial, p_brand
 from (select cast(100 + p_partkey * 7 % 500 as varchar) as c, p_brand from part) group by p_brand""")
def class_regex(spark, sf):
    p = Tables(spark, sf).part.select("p_brand", (100 + F.col("p_partkey") * 7 % 500).cast("string").alias("c"))
    return p.groupBy("p_brand").agg(*[F.count_if(c).alias(n) for n, c in X.property_class(F.col("c")).items()])


@query("""select o_orderkey, try_cast(t as double) / 100 as price from (select o_orderkey, case when o_orderkey % 5 = 0 then o_orderpriority else cast(o_orderkey * 37 as varchar) end as t from orders)""")
def try_numeric(spark, sf):
    t = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise((F.col("o_orderkey") * 37).cast("string"))
    return Tables(spark, sf).orders.select("o_orderkey", X.number(t, 100).alias("price"))


@query("""select cast(coalesce(try_strptime(t, '%m/%d/%Y'), try_strptime(t, '%Y-%m-%d')) as date)::varchar as day, count(*) as n from (select case o_orderkey % 3 when 0 then strftime(o_orderdate, '%m/%d/%Y')
 when 1 then strftime(o_orderdate, '%Y-%m-%d') else o_orderpriority end as t from orders) group by 1""")
def date_parse(spark, sf):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return Tables(spark, sf).orders.select(X.mixed_date(t).cast("string").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, case when regexp_full_match(k, '[A-Za-z0-9-]+') then 'IN:SDF:' || k end as source_key from (select o_orderkey, case when o_orderkey % 7 = 0 then o_orderpriority || ' ' || o_orderkey else '49-' || o_orderkey end as k from orders)""")
def key_build(spark, sf):
    s = F.col("o_orderkey").cast("string")
    k = F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws(" ", "o_orderpriority", s)).otherwise(F.concat(F.lit("49-"), s))
    return Tables(spark, sf).orders.select("o_orderkey", X.source_key(k, "IN:SDF:").alias("source_key"))


@query("""select l_returnflag, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as total from lineitem where l_extendedprice > 50000 and l_extendedprice <= 90000 group by l_returnflag""")
def price_bounds_filter(spark, sf):
    li = Tables(spark, sf).lineitem.where(X.in_bounds(F.col("l_extendedprice"), 50_000, 90_000))
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), exact_sum(F.col("l_extendedprice")).alias("total"))


@query("""select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R' and l_linestatus = 'F' and l_discount < 0.05 and l_tax <= 0.04 and l_quantity >= 10 and l_extendedprice > 50000 and l_extendedprice <= 15000000""")
def arms_length_filter(spark, sf):
    li = Tables(spark, sf).lineitem
    keep = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.05) & (F.col("l_tax") <= 0.04) & (F.col("l_quantity") >= 10)
    return li.where(keep & X.in_bounds(F.col("l_extendedprice"))).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""select case when year(o_orderdate) between 1995 and 1996 then 'BASELINE' when year(o_orderdate) between 1997 and 1998 then 'TRANSITION' when year(o_orderdate) between 1999 and 2000 then 'SHOCK' end as regime, count(*) as n from orders group by 1""")
def regime_case(spark, sf):
    eras = (("BASELINE", 1995, 1996), ("TRANSITION", 1997, 1998), ("SHOCK", 1999, 2000))
    return Tables(spark, sf).orders.select(X.regime(F.year("o_orderdate"), eras).alias("regime")).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


@query("""select (year(o_orderdate) >= 1999)::int as post, (n_regionkey = 1)::int as treated, ((year(o_orderdate) >= 1999) and n_regionkey = 1)::int as did, count(*) as n
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3""")
def post_treated_did(spark, sf):
    t = Tables(spark, sf)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    post, treated = (F.year("o_orderdate") >= 1999).cast("int"), (F.col("n_regionkey") == 1).cast("int")
    return j.select(post.alias("post"), treated.alias("treated"), (post * treated).alias("did")).groupBy("post", "treated", "did").agg(F.count(F.lit(1)).alias("n"))


_REASONS = """select reasons, count(*) as n, count(*) filter (reasons = '') as eligible from (select concat_ws(';', case when coalesce(f is null, {0}) then 'status_unknown' end, case when coalesce(p <= 50000, {0}) then 'price_at_or_below_floor' end,
 case when coalesce(p > 90000, {0}) then 'price_above_cap' end, case when coalesce(f = 'N', {0}) then 'not_valid_for_trending' end) as reasons
 from (select nullif(l_returnflag, 'A') as f, case when l_linenumber <> 3 then l_extendedprice end as p from lineitem)) group by reasons"""


def _reasons(spark, sf, unknown):
    f, p = F.nullif(F.col("l_returnflag"), F.lit("A")), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    rules = [("status_unknown", f.isNull()), ("price_at_or_below_floor", p <= 50000), ("price_above_cap", p > 90000), ("not_valid_for_trending", f == "N")]
    d = Tables(spark, sf).lineitem.select(X.reasons(rules, unknown).alias("reasons"))
    return d.groupBy("reasons").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.eligible(F.col("reasons"))).alias("eligible"))


@query(_REASONS.format("true"))
def reasons_unknown_fails(spark, sf):
    return _reasons(spark, sf, True)


@query(_REASONS.format("false"))
def reasons_unknown_passes(spark, sf):
    return _reasons(spark, sf, False)


@query("""select count(*) filter (l_quantity is null) as null_quantity, count(*) filter (l_extendedprice is null) as null_price, count(*) filter (l_extendedprice <= 900) as below_floor,
 count(*) filter (l_extendedprice > 110000) as above_cap, count(*) as total, count(*) filter (not regexp_full_match(cast(l_orderkey as varchar), '[0-9]+')) as bad_keys from lineitem""")
def row_invariants(spark, sf):
    p = F.col("l_extendedprice")
    return Tables(spark, sf).lineitem.agg(
        F.count_if(F.col("l_quantity").isNull()).alias("null_quantity"), F.count_if(p.isNull()).alias("null_price"), F.count_if(p <= 900).alias("below_floor"), F.count_if(p > 110000).alias("above_cap"),
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("l_orderkey").cast("string").rlike("^[0-9]+$")).alias("bad_keys"),
    )


@query("""select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def key_duplicates(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""select c_custkey, c_name from customer where regexp_matches(c_name, '^(Customer#0000001|Customer#0000002)')""")
def prefix_filter(spark, sf):
    return Tables(spark, sf).customer.where(F.col("c_name").rlike("^(Customer#0000001|Customer#0000002)")).select("c_custkey", "c_name")


@query("""select count(*) filter (l_extendedprice between 0 and 50000) as b1, count(*) filter (l_extendedprice between 50000 and 75000) as b2, count(*) filter (l_extendedprice between 75000 and 110000) as b3, l_returnflag from lineitem group by l_returnflag""")
def range_counts(spark, sf):
    b = [(0, 50000), (50000, 75000), (75000, 110000)]
    return Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(*[F.count_if(F.col("l_extendedprice").between(*x)).alias(f"b{i}") for i, x in enumerate(b, 1)])


@query("""select 'documents' as tab, doc_id as id from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}|\\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\\b')
 union all select 'conversations', conv_id from conversations where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}|\\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\\b')""")
def privacy_scan(spark, sf):
    t = Tables(spark, sf)
    docs = t.documents.where(X.holds_party_text(F.col("text"))).select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"))
    return docs.unionAll(t.conversations.where(X.holds_party_text(F.col("text"))).select(F.lit("conversations"), "conv_id"))


@query("""select event_id, json_extract_string(props, '$.k') as k from events""")
def json_extract_fields(spark, sf):
    return Tables(spark, sf).events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""select year(o_orderdate) * 100 + month(o_orderdate) as time_id, strftime(o_orderdate, '%Y-%m') as sale_month, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) as sale_quarter, dayname(o_orderdate) as day_name, count(*) as n from orders group by 1, 2, 3, 4""")
def calendar_fields(spark, sf):
    d = F.col("o_orderdate")
    o = Tables(spark, sf).orders.select(
        X.months_between_ids(F.year(d), F.month(d)).cast("long").alias("time_id"), F.date_format(d, "yyyy-MM").alias("sale_month"), F.concat(F.date_format(d, "yyyy"), F.lit("Q"), F.quarter(d).cast("string")).alias("sale_quarter"), F.date_format(d, "EEEE").alias("day_name"))
    return o.groupBy("time_id", "sale_month", "sale_quarter", "day_name").agg(F.count(F.lit(1)).alias("n"))


@query("""select o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) as row_hash from orders""")
def content_hash(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("row_hash"))
