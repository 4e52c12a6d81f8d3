"""Queries of the disclosure normalisers, over raw tables that Spark derives from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotline.operators import contract as C
from plotline.operators import disclosures as D
from plotline.plans.registry import Tables, query

#: County codes with name, FIPS code and tier type.
COUNTIES = {"06": ("Boone", "18011", "SUBURBAN_COLLAR"), "29": ("Hamilton", "18057", "SUBURBAN_COLLAR"), "32": ("Hendricks", "18063", "SUBURBAN_COLLAR"), "41": ("Johnson", "18081", "SUBURBAN_COLLAR"), "49": ("Marion", "18097", "URBAN_CORE")}
_PLACES = ", ".join(f"('{k}', '{a}', '{b}', '{c}')" for k, (a, b, c) in COUNTIES.items())

_ID = "case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'no key!' else cast(o_orderkey as {0}) end"
_LEGACY = {
    "SDF_ID": _ID, "County_ID": "cast(o_custkey % 60 as {0})", "C6_Sales_Price": "case when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then 'unknown' else cast(cast(floor(o_totalprice) as bigint) as {0}) end",
    "PropZip": "concat(cast(o_custkey as {0}), '-0001')", "Parcel1": "cast(o_orderkey as {0})", "Parcel2": "case when o_totalprice > 200000 then 'second' end",
    "P2_6_Prop_Class_Code": "case o_orderpriority when '1-URGENT' then ' 510 ' when '2-HIGH' then '550' when '3-MEDIUM' then '101' when '4-NOT SPECIFIED' then '' end",
    "P2_16_Valid_Trending": "case o_orderstatus when 'F' then 'Y' when 'O' then 'n' else '?' end", "P2_17_Validation_Complete": "case when o_totalprice > 100000 then '1' else 'No' end", "Quitclaim": "case when o_orderpriority = '1-URGENT' then 'yes' end",
}
_SALES = {
    "SDF_ID": _ID, "County_ID": "cast(o_custkey % 60 as {0})", "E1_Sales_Price": "cast(cast(round(o_totalprice * 100) as bigint) as {0})", "P2_16_Valid_Trending": "case o_orderstatus when 'F' then 'Y' when 'O' then 'n' end",
    "P2_17_Validation_Complete": "case when o_totalprice > 100000 then 'YES' end", "B1_Valuable_Consider": "case when o_orderpriority <> '5-LOW' then 'Y' else 'N' end", "C10_Residential_Property": "'Y'",
    "C10_Agricultural_Property": "case when o_orderpriority = '3-MEDIUM' then 'Y' else 'N' end", "C10_Commercial_Property": "'0'", "C10_Industrial_Property": "case when o_orderstatus = 'P' then null else 'N' end",
    "C1_Sheriff_Sale": "'N'", "C2_Short_Sale": "case when o_totalprice > 400000 then 'Y' else 'N' end", "C3_Quitclaim": "'N'", "C8_Market_Days": "cast(o_custkey % 200 as {0})",
}
_PARCELS = {
    "SDF_ID": "cast(l_orderkey as {0})", "Parcel_Instance_No": "case when l_linestatus = 'F' then cast(l_linenumber as {0}) end", "A5_ZipCode": "case when l_returnflag = 'A' then 'none' else cast(l_partkey % 99999 as {0}) end",
    "P2_6_Prop_Class_Code": "case when l_quantity < 20 then '511' when l_quantity < 40 then ' 520' when l_quantity < 45 then '' else '425' end",
}
_DAY = {"F": "MM/dd/yyyy", "O": "yyyy-MM-dd"}


def _sql(columns: dict, more: str, table: str) -> str:
    return "select " + ", ".join(f"{v.format('varchar')} as {k}" for k, v in columns.items()) + f"{more} from {table}"


def _frame(df, columns: dict):
    return df.select(*[F.expr(v.format("string")).alias(k) for k, v in columns.items()], *df.columns)


def _orders(t, columns: dict, date: str):
    day = F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.date_format("o_orderdate", f)) for s, f in _DAY.items()], F.lit("soon"))
    return _frame(t.orders, columns).withColumn(date, day)


_FLAG = "case when upper(trim({0})) in ('Y', 'YES', '1') then true when upper(trim({0})) in ('N', 'NO', '0') then false end"
_BASE = """case when regexp_full_match(trim(SDF_ID), '[A-Za-z0-9-]+') then 'IN:SDF:' || trim(SDF_ID) end as source_key, lpad(County_ID, greatest(2, length(County_ID))::int, '0') as county_dlgf_code, p.county, p.county_fips, p.tier_type,
 case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') end as sale_date, cast(case when o_orderstatus <> 'P' then year(o_orderdate) end as integer) as sale_year, case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m') end as sale_month"""
_JOIN = f"left join (values {_PLACES}) p(code, county, county_fips, tier_type) on p.code = lpad(County_ID, greatest(2, length(County_ID))::int, '0')"
_SHOWN = ["source_key", "county_dlgf_code", "county", "county_fips", "tier_type", "sale_date", "sale_year", "sale_month", "gross_sale_price", "property_zip", "parcel_count", "property_class_codes", "validation_complete", "valid_for_trending", "quitclaim", "residential_property", "agricultural_property", "all_parcels_improved_residential", "all_parcels_single_family"]
_CLASS = "nullif(trim(P2_6_Prop_Class_Code), '')"
_ZIP = "case when regexp_full_match({0}, '[0-9]{{3,5}}') and lpad({0}, 5, '0') <> '00000' then lpad({0}, 5, '0') end"
_LEGACY_SQL = f"""legacy as (select {_BASE}, case when C6_Sales_Price <> 'unknown' then cast(C6_Sales_Price as double) end as gross_sale_price, {_ZIP.format("split_part(PropZip, '-', 1)")} as property_zip, cast((Parcel1 is not null)::int + (Parcel2 is not null)::int as integer) as parcel_count,
 {_CLASS} as property_class_codes, {_FLAG.format('P2_17_Validation_Complete')} as validation_complete, {_FLAG.format('P2_16_Valid_Trending')} as valid_for_trending, {_FLAG.format('Quitclaim')} as quitclaim,
 coalesce(regexp_full_match({_CLASS}, '5[0-9]{{2}}'), false) as residential_property, coalesce(regexp_full_match({_CLASS}, '[12][0-9]{{2}}'), false) as agricultural_property,
 coalesce(regexp_full_match({_CLASS}, '5[1-9][0-9]'), false) as all_parcels_improved_residential, coalesce(regexp_full_match({_CLASS}, '51[0-5]'), false) as all_parcels_single_family, o_orderkey, 1998 as source_year
 from ({_sql(_LEGACY, ', o_orderkey, o_orderdate, o_orderstatus', 'orders')}) {_JOIN})"""
_SUMMARY_SQL = f"""parcels as (select distinct * from ({_sql(_PARCELS, '', 'lineitem')})), pc as (select SDF_ID, try_cast(Parcel_Instance_No as double) as nth, {_ZIP.format('A5_ZipCode')} as zip, {_CLASS} as kind from parcels),
 summary as (select SDF_ID, cast(count(*) as integer) as parcel_count, arg_min(zip, (nth is null, nth, zip)) filter (zip is not null) as property_zip, string_agg(distinct kind, ';' order by kind) as property_class_codes,
 coalesce(bool_and(regexp_full_match(kind, '5[1-9][0-9]')), false) as all_parcels_improved_residential, coalesce(bool_and(regexp_full_match(kind, '51[0-5]')), false) as all_parcels_single_family from pc group by 1)"""
_MODERN_SQL = _SUMMARY_SQL + f""", modern as (select {_BASE}, cast(E1_Sales_Price as double) / 100 as gross_sale_price, property_zip, parcel_count, property_class_codes, {_FLAG.format('P2_17_Validation_Complete')} as validation_complete, {_FLAG.format('P2_16_Valid_Trending')} as valid_for_trending,
 {_FLAG.format('C3_Quitclaim')} as quitclaim, {_FLAG.format('C10_Residential_Property')} as residential_property, {_FLAG.format('C10_Agricultural_Property')} as agricultural_property, {_FLAG.format('C10_Commercial_Property')} as commercial_property, {_FLAG.format('C10_Industrial_Property')} as industrial_property,
 {_FLAG.format('B1_Valuable_Consider')} as valuable_consideration, {_FLAG.format('C1_Sheriff_Sale')} as sheriff_sale, {_FLAG.format('C2_Short_Sale')} as short_sale, coalesce(all_parcels_improved_residential, false) as all_parcels_improved_residential,
 coalesce(all_parcels_single_family, false) as all_parcels_single_family, o_orderkey, 1998 as source_year from ({_sql(_SALES, ', o_orderkey, o_orderdate, o_orderstatus', 'orders')}) s left join summary using (SDF_ID) {_JOIN})"""


def _legacy(t):
    return D.normalize_legacy(_orders(t, _LEGACY, "Conveyance_Date"), year=1998, file="SDF1998.txt", counties=COUNTIES)


def _modern(t):
    return D.normalize_modern(_orders(t, _SALES, "C7_Conveyance_Date"), _frame(t.lineitem, _PARCELS).select(*_PARCELS), year=1998, file="SALEDISC1998.txt", counties=COUNTIES)


@query(f"with {_LEGACY_SQL} select {', '.join(_SHOWN)} from legacy")
def legacy_contract(spark, sf):
    return _legacy(Tables(spark, sf)).select(*_SHOWN)


@query(f"with {_SUMMARY_SQL} select * from summary")
def parcel_summary(spark, sf):
    t = Tables(spark, sf)
    return D.summarize_parcels(_frame(t.lineitem, _PARCELS).select(*_PARCELS))


@query(f"with {_MODERN_SQL} select {', '.join(_SHOWN)} from modern")
def modern_contract(spark, sf):
    return _modern(Tables(spark, sf)).select(*_SHOWN)


_REASONS = """case when sale_date is null then 'invalid_sale_date' end, case when coalesce(sale_year <> source_year, true) then 'sale_year_mismatch' end, case when gross_sale_price is null then 'invalid_sale_price' end,
 case when gross_sale_price <= 50000 then 'price_at_or_below_floor' end, case when gross_sale_price > 15000000 then 'price_above_cap' end"""
_LEGACY_REASONS = """case when validation_complete is distinct from true then 'validation_incomplete' end, case when valid_for_trending is distinct from true then 'not_valid_for_trending' end, case when not all_parcels_improved_residential then 'not_improved_residential' end"""
_MODERN_REASONS = """case when valuable_consideration is distinct from true then 'not_valuable_consideration' end, case when not coalesce(residential_property and not agricultural_property and not commercial_property and not industrial_property, false) then 'not_residential_only' end,
 case when sheriff_sale is distinct from false then 'sheriff_sale_or_unknown' end, case when short_sale is distinct from false then 'short_sale_or_unknown' end, case when quitclaim is distinct from false then 'quitclaim_or_unknown' end"""
_STRICT_REASONS = """case when validation_complete is distinct from true then 'validation_incomplete' end, case when valid_for_trending is distinct from true then 'not_valid_for_trending' end, case when coalesce(parcel_count, 0) <= 0 then 'missing_parcel' end,
 case when not all_parcels_improved_residential then 'not_all_parcels_improved_residential' end"""


@query(f"""with {_LEGACY_SQL}, {_MODERN_SQL}, e as (select 'legacy' as layout, concat_ws(';', {_REASONS}, {_LEGACY_REASONS}) as current, concat_ws(';', {_REASONS}, {_LEGACY_REASONS}) as strict from legacy
 union all select 'modern', concat_ws(';', {_REASONS}, {_MODERN_REASONS}), concat_ws(';', {_REASONS}, {_MODERN_REASONS}, {_STRICT_REASONS}) from modern)
 select layout, current, strict, count(*) as n, count(*) filter (current = '') as eligible_current, count(*) filter (strict = '') as eligible_strict from e group by 1, 2, 3""")
def disclosure_eligibility(spark, sf):
    t = Tables(spark, sf)
    e = D.eligibility(_legacy(t).unionByName(_modern(t)))
    layout = F.when(F.col("source_format") == "legacy_pipe_v1", "legacy").otherwise("modern")
    g = e.groupBy(layout.alias("layout"), F.col("exclusion_reasons_current").alias("current"), F.col("exclusion_reasons_strict").alias("strict"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible_current_study").alias("eligible_current"), F.count_if("eligible_strict_comparable").alias("eligible_strict"))


#: Keys of customers come back in later years: as the same sale, with another status, or with another price.
_SOURCES = """f as (select o_orderkey as id, case when o_orderpriority <> '5-LOW' then 'IN:SDF:' || o_custkey end as source_key, year(o_orderdate) as source_year, year(o_orderdate) + case when o_orderstatus = 'P' then 1 else 0 end as sale_year,
 floor(o_totalprice / 400000) as price, case o_orderstatus when 'F' then true when 'O' then false end as status from orders)"""


def _kinds(scope: str, table: str) -> str:
    by = f"{scope} source_key"
    return f"""(select x.*, case when x.source_key is null then 'invalid_key' when n = 1 then 'unique' when alls = 1 then 'exact' when prices = 1 then 'status_variant' else 'conflict' end as disposition, statuses,
 row_number() over (partition by {', '.join(f'x.{c}' for c in by.replace(',', ' ').split())} order by (x.sale_year = x.source_year) desc, x.source_year desc, x.id desc) as k from {table} x
 left join (select {by}, count(*) as n, count(distinct price) as prices, count(distinct (price, status)) as alls, count(distinct coalesce(status::varchar, '-')) as statuses from {table} where source_key is not null group by all) g using ({by}))"""


_KEPT = "disposition in ('unique', 'exact', 'status_variant') and k = 1"
_SETTLED = f"""{_SOURCES}, d1 as {_kinds('source_year,', 'f')}, k1 as (select id, source_key, source_year, sale_year, price, case when disposition <> 'status_variant' or statuses = 1 then status end as status, disposition = 'status_variant' as mixed from d1 where {_KEPT}),
 d2 as {_kinds('', 'k1')}, h as (select id, source_key, source_year, case when disposition <> 'status_variant' or statuses = 1 then status end as status, mixed or disposition = 'status_variant' as mixed from d2 where {_KEPT})"""


def _sources(spark, sf):
    f = Tables(spark, sf).orders.selectExpr(
        "o_orderkey as id", "case when o_orderpriority <> '5-LOW' then concat('IN:SDF:', o_custkey) end as source_key", "cast(year(o_orderdate) as bigint) as source_year", "cast(year(o_orderdate) + if(o_orderstatus = 'P', 1, 0) as bigint) as sale_year",
        "floor(o_totalprice / 400000) as price", "case o_orderstatus when 'F' then true when 'O' then false end as status", "false as mixed",
    )
    history, disposed = D.combine_sources(f, core=["price"], status=["status"], conflict="mixed", prefer=[F.desc(F.col("sale_year") == F.col("source_year")), F.desc("source_year"), F.desc("id")], decide=lambda d: d)
    return f, history, disposed


@query(f"with {_SETTLED} select * from h")
def cross_source_history(spark, sf):
    return _sources(spark, sf)[1].select("id", "source_key", "source_year", "status", "mixed")


@query(f"""with {_SETTLED}, lost as (select source_year, disposition from d1 where not ({_KEPT}) union all select source_year, disposition from d2 where not ({_KEPT})),
 l as (select source_year, count(*) filter (disposition = 'invalid_key') as invalid, count(*) filter (disposition = 'exact') as exact, count(*) filter (disposition = 'status_variant') as variant, count(*) filter (disposition = 'conflict') as conflicting from lost group by 1)
 select r.source_year, raw, coalesce(invalid, 0) as invalid, coalesce(exact, 0) as exact, coalesce(variant, 0) as variant, coalesce(conflicting, 0) as conflicting, coalesce(kept, 0) as kept, true as balanced
 from (select source_year, count(*) as raw from f group by 1) r left join l using (source_year) left join (select source_year, count(*) as kept from h group by 1) using (source_year)""")
def cross_source_funnel(spark, sf):
    rows, history, disposed = _sources(spark, sf)
    return D.source_funnel(rows, history, disposed, ["source_year"])


_STATE1 = ["source_key", "source_state", "source_schema", "sale_year", "county", "county_fips", "gross_sale_price", "parcel_count", "property_type_evidence", "single_family", "strict_eligibility_available", "research_eligible", "exclusion_reasons_research", "regime"]


@query(f"""with {_LEGACY_SQL}, {_MODERN_SQL}, e as (select 'legacy_pipe_v1' as source_schema, source_key, sale_year, county, county_fips, gross_sale_price, parcel_count, property_class_codes, validation_complete, valid_for_trending, all_parcels_single_family, concat_ws(';', {_REASONS}, {_LEGACY_REASONS}) as current from legacy
 union all select 'modern_multifile_v1', source_key, sale_year, county, county_fips, gross_sale_price, parcel_count, property_class_codes, validation_complete, valid_for_trending, all_parcels_single_family, concat_ws(';', {_REASONS}, {_MODERN_REASONS}) from modern)
 select source_key, 'IN' as source_state, source_schema, sale_year, county, county_fips, gross_sale_price, parcel_count, property_class_codes as property_type_evidence, all_parcels_single_family as single_family, validation_complete is not null and valid_for_trending is not null as strict_eligibility_available,
 current = '' and all_parcels_single_family as research_eligible, concat_ws(';', case when current <> '' then 'not_current_study_eligible' end, case when not all_parcels_single_family then 'not_single_family' end) as exclusion_reasons_research,
 case when sale_year between 1995 and 1997 then 'BASELINE' when sale_year between 1998 and 2000 then 'SHOCK' end as regime from e where sale_year between 1996 and 2001""")
def first_state_contract(spark, sf):
    t = Tables(spark, sf)
    rows = D.eligibility(_legacy(t).unionByName(_modern(t)))
    return C.prepare_first_state(rows, first=1996, last=2001, counties=[c[0] for c in COUNTIES.values()], eras=(("BASELINE", 1995, 1997), ("SHOCK", 1998, 2000))).select(*_STATE1)


_STATE2 = ["source_key", "source_snapshot", "sale_year", "county", "tier_type", "gross_sale_price", "adjusted_price", "personal_property_total", "parcel_count", "property_type_evidence", "single_family", "eligible_current_study", "strict_eligibility_available", "research_eligible", "exclusion_reasons_current", "exclusion_reasons_strict", "exclusion_reasons_research", "revision_conflict", "probate_deed", "reporting_lag_days", "reporting_maturity_days", "recent_reporting_period", "regime"]
_ANSWERS = {f: "case o_orderstatus when 'F' then 'N' when 'O' then '0' end" for f in C.DISQUALIFYING} | {"gift": "case when o_orderpriority = '1-URGENT' then 'true' else 'false' end", "related": "case when o_totalprice > 450000 then 'Y' when o_totalprice > 100000 then 'no' end"}
_RECORDS = {
    "source_key": "concat('MN:ecrv:', o_orderkey)", "archive_name": "concat('week', cast(year(o_orderdate) as {0}), '.zip')", "county_name": "concat('County ', o_custkey % 7)", "is_twin_cities": "case when o_custkey % 10 < 8 then 1 else 0 end",
    "gross_sale_price": "cast(o_totalprice as {0})", "seller_paid_points": "case when o_orderpriority <> '5-LOW' then '100.5' end", "personal_property_included": "case o_orderstatus when 'F' then 'true' when 'O' then 'false' end", "revision_conflict": "case when o_custkey % 9 > 0 then '0' end",
    "deed_type": "case o_orderpriority when '1-URGENT' then 'warranty' when '2-HIGH' then 'Quitclaim' when '3-MEDIUM' then 'PerRepDeed' end",
} | _ANSWERS
_RECORDS_SQL = f"""r as ({_sql(_RECORDS, ", strftime(o_orderdate, '%Y-%m-%d') as sale_date, year(o_orderdate) as sale_year, o_orderkey, o_orderdate::date as day", 'orders')}),
 u as (select l_orderkey, bool_and(l_returnflag = 'A' or l_linestatus = 'F') as single_family, string_agg(distinct case when l_returnflag = 'A' then 'RES:HOUSESGL|' else 'FARM|' end || case when l_linestatus = 'F' then 'RESID:SINGLEFAM' else 'RESID' end, ';' order by case when l_returnflag = 'A' then 'RES:HOUSESGL|' else 'FARM|' end || case when l_linestatus = 'F' then 'RESID:SINGLEFAM' else 'RESID' end) as evidence from lineitem where l_linenumber < 4 group by 1),
 p as (select l_orderkey, count(distinct l_partkey) as plots from lineitem group by 1), g as (select l_orderkey, cast(sum(cast(l_quantity as decimal(18,4))) as double) as total, bool_and(l_tax > 0) as complete from (select l_orderkey, l_tax, case when l_tax > 0 then l_quantity end as l_quantity from lineitem where l_linestatus = 'O') group by 1),
 s as (select l_orderkey, min(l_shipdate)::date as seen from lineitem group by 1)"""
_BAD = "revision_conflict is null"
_SHARED2 = f"case when not (price > 50000 and price <= 15000000) then 'price_out_of_bounds' end, case when {_BAD} then 'revision_conflict' end"
_YES = "lower({0}) in ('y', 'yes', '1', 'true')"
_KNOWN2 = "deed is not null" + "".join(f" and {f} is not null" for f in C.DISQUALIFYING)


@query(f"""with {_RECORDS_SQL}, j as (select r.*, price_ as price, upper(deed_type) as deed, u.single_family, evidence, plots, total, complete, seen, date_diff('day', day, seen)::int as lag from (select *, cast(gross_sale_price as double) as price_ from r where is_twin_cities = 1 and sale_year between 1996 and 2000) r
 left join u on u.l_orderkey = o_orderkey left join p on p.l_orderkey = o_orderkey left join g on g.l_orderkey = o_orderkey left join s on s.l_orderkey = o_orderkey),
 m as (select max(case when k = ceil((n - 1) * 0.95) then lag end) as maturity from (select lag, row_number() over (order by lag) - 1 as k, count(*) over () as n from j where lag >= 0)),
 c as (select j.*, maturity, concat_ws(';', {_SHARED2}, {', '.join(f"case when {_YES.format(f)} then '{f}' end" for f in C.DISQUALIFYING)}, case when deed = 'QUITCLAIM' then 'quitclaim' end) as current,
  concat_ws(';', {_SHARED2}, {', '.join(f"case when {f} is null or {_YES.format(f)} then '{f}_or_unknown' end" for f in C.DISQUALIFYING)}, case when deed = 'QUITCLAIM' then 'quitclaim' end, case when deed is null then 'deed_type_unknown' end) as strict,
  coalesce(personal_property_included = 'false' or (personal_property_included = 'true' and total is not null and complete), false) as done, case when personal_property_included = 'true' then coalesce(total, 0) else 0 end as sold from j cross join m),
 f as (select *, (select max(seen) from c) as last_seen from c)
 select source_key, archive_name || '@2001' as source_snapshot, sale_year::int as sale_year, county_name as county, case when county_name = 'County 0' then 'URBAN_CORE' else 'SUBURBAN_COLLAR' end as tier_type, price as gross_sale_price,
  case when done and seller_paid_points is not null and price - sold - 100.5 > 0 then price - sold - 100.5 end::double as adjusted_price, case when done then sold end::double as personal_property_total, plots::int as parcel_count, evidence as property_type_evidence, single_family, current = '' as eligible_current_study,
  {_KNOWN2} as strict_eligibility_available, current = '' and coalesce(single_family, false) as research_eligible, current as exclusion_reasons_current, strict as exclusion_reasons_strict,
  concat_ws(';', nullif(current, ''), case when not coalesce(single_family, false) then 'not_single_family' end) as exclusion_reasons_research, case when revision_conflict = '0' then false end as revision_conflict, deed in ('PROBATE', 'PERREPDEED') as probate_deed,
  lag as reporting_lag_days, maturity::int as reporting_maturity_days, day > last_seen - maturity::int as recent_reporting_period, case when sale_year <= 1997 then 'BASELINE' else 'SHOCK' end as regime from f""")
def second_state_contract(spark, sf):
    t = Tables(spark, sf)
    seen = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_extract_timestamp"))
    sales = _frame(t.orders, _RECORDS).join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sales = sales.withColumns({
        "sale_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "sale_year": F.year("o_orderdate"), "sale_month": F.date_format("o_orderdate", "yyyy-MM"), "county_fips": F.lit("27001"), "schema_variant": F.lit("modern"), "parse_recovered": F.lit("0"), "recovery_method": F.lit(None).cast("string"),
        "extract_timestamp": F.lit("2001"), "version_id": F.lit("1"), "new_buildings_sale_year": F.lit("N"), "first_extract_timestamp": F.date_format("first_extract_timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
    })
    key = F.concat(F.lit("MN:ecrv:"), F.col("l_orderkey")).alias("source_key")
    legacy, modern = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F"
    uses = t.lineitem.select(key, F.when(F.col("l_linenumber") < 4, "Before").otherwise("after").alias("use_timing"), F.lit("RESID").alias("tier1Cde"), F.when(modern, "SINGLEFAM").alias("tier2Cde"), F.when(legacy, "RES").otherwise("FARM").alias("propertyTypeCode"), F.when(legacy, "HOUSESGL").alias("propertyUseCode"))
    goods = t.lineitem.select(key, F.when(F.col("l_linestatus") == "O", "Y").otherwise("N").alias("selected"), F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("string")).alias("propertyValue"))
    out = C.prepare_second_state(sales, uses, t.lineitem.select(key, F.col("l_partkey").alias("parcelId")), goods, first=1996, last=2000, counties=[f"County {i}" for i in range(7)], urban=["County 0"], eras=(("BASELINE", 1995, 1997), ("SHOCK", 1998, 2000)))
    return out.select(*_STATE2)
