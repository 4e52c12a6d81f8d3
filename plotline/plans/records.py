"""Queries on XML sale records: transactions, child tables, revisions and the contract made from them.

The members are made from orders and line items, with each fault that the parser's rules know; the SQL says from the same
rows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.operators import contract as C
from plotline.operators import joins as J
from plotline.operators import versions as V
from plotline.operators import xml_records as XML
from plotline.plans.registry import Tables, query

_WRAP = XML.WRAPPER


def _tag(name: str, value: Column) -> Column:
    """<name>value</name>, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>")), F.lit(""))


def _every(k: Column, n: int) -> Column:
    return k % n == 0


def _orders(spark, sf: str) -> DataFrame:
    """The orders with the XML of their line items: parcel, use and goods, and use_again of version 2."""
    t = Tables(spark, sf)
    k, n, flag = F.col("o_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")
    # line items are dealt by order as they are, texts are made of them there
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice").repartition("o_orderkey")
    parcel = F.when(n == 7, F.lit("<parcels/>")).otherwise(F.concat(F.lit("<parcels>"), _tag("id", n), _tag("parcelId", F.col("l_partkey")), _tag("primary", F.when(n == 1, "true")), F.lit("</parcels>")))
    codes = (
        F.when(~_every(k, 3) & _every(k, 2), F.concat(_tag("propertyTypeCode", F.when(n < 3, "RES").otherwise("COM")), _tag("propertyUseCode", F.lit("HOUSESGL"))))
        .otherwise(F.concat(_tag("tier1Cde", F.when(n < 5, "RESID").otherwise("COMM")), _tag("tier2Cde", F.lit("SINGLEFAM"))))
    )
    timing = F.when(flag == "A", "usesBeforeSale").when(flag == "R", "plannedUses")
    use = F.when(timing.isNotNull(), F.concat(F.lit("<"), timing, F.lit(">"), _wrapped("PlannedUseForm", F.concat(_tag("id", n), codes)), F.lit("</"), timing, F.lit(">")))
    value = F.when(n == 4, F.lit(None)).otherwise(F.format_string("%.2f", F.col("l_extendedprice")))
    goods = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("<personalProperties>"), _tag("id", n), _tag("selected", F.when(n % 2 == 1, "true").otherwise("no")), _tag("propertyValue", value), F.lit("</personalProperties>")))
    texts = lines.select("o_orderkey", F.struct(n.alias("n"), *[F.coalesce(c, F.lit("")).alias(name) for name, c in (("parcel", parcel), ("use", use), ("goods", goods))], (flag == "A").alias("before")).alias("line"))
    kids = texts.groupBy("o_orderkey").agg(F.collect_list("line").alias("lines"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").join(kids, "o_orderkey", "left")

    def ordered(name, lines="lines"):
        pairs = F.array_sort(F.transform(lines, lambda x: F.struct(x["n"], x[name].alias("x"))))
        return F.coalesce(F.array_join(F.transform(pairs, lambda s: s["x"]), ""), F.lit(""))

    planned = F.filter("lines", lambda x: ~F.coalesce(x["before"], F.lit(False)))
    o = o.withColumns({name: ordered(name) for name in ("parcel", "use", "goods")} | {"lines": F.when(_every(k, 9), planned)})
    return o.withColumn("use_again", F.when(_every(k, 9), ordered("use")).otherwise(F.col("use"))).drop("lines")


def _wrapped(form: str, body: Column) -> Column:
    return F.when(~_every(F.col("o_orderkey"), 3), F.concat(F.lit(f"<{_WRAP}{form}>"), body, F.lit(f"</{_WRAP}{form}>"))).otherwise(body)


def _form(again: bool) -> Column:
    """The text of an order's member."""
    k = F.col("o_orderkey")
    legacy = ~_every(k, 3)
    none = F.lit("")
    county = F.when(_every(k, 37), (k % 90).cast("string")).otherwise(F.lpad((k % 90).cast("string"), 2, "0"))
    day = F.when(_every(k, 29), F.lit("1996-02-31T00:00:00-06:00")).when(_every(k, 31), F.lit("1996-2-3")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00-06:00"))
    price = F.when(_every(k, 17), none).when(_every(k, 41), F.lit(".5")).when(_every(k, 43), F.lit("1e5")).when(_every(k, 47), F.lit("NaN")).when(_every(k, 53), F.lit("-1.50")).otherwise(F.format_string("%.4f", F.col("o_totalprice")))
    points = F.when(_every(k, 79), F.lit("abc")).when(_every(k, 4), (k % 1000 + (F.when(_every(k, 7), 1).otherwise(0) if again else 0)).cast("string"))
    deed = F.when(_every(k, 10), F.lit("QUITCLAIM")).when(~_every(k, 6), F.lit("LIMWARRNTY"))
    deed = F.when(_every(k, 5), F.lit("TRUSTEE")).otherwise(deed) if again else deed
    note = F.when(_every(k, 11), F.lit("a&#11;b")).when(_every(k, 13), F.lit("a\x0bb")).when(_every(k, 61), F.lit("a & b")).when(_every(k, 73), F.lit("café")).otherwise(F.lit(" ok "))
    money = F.when(_every(k, 2), F.concat(F.lit("<financeArrangements>"), _wrapped("FinanceForm", F.concat(_tag("id", k), _tag("selected", F.lit("true")), _tag("contractMortgageAmt", F.col("o_custkey")))), F.lit("</financeArrangements>"))).otherwise(none)
    root = F.when(_every(k, 83), F.lit("other")).when(legacy, F.lit(XML.ROOTS[1])).otherwise(F.lit(XML.ROOTS[0]))
    start = F.when(_every(k, 59), F.lit(' <?xml version="1.0"?>')).when(_every(k, 67), F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>')).when(_every(k, 71), F.lit("<!DOCTYPE x>")).otherwise(F.lit('<?xml version="1.0" encoding="UTF-8"?>'))
    return F.concat(
        start, F.lit("<"), root, F.lit(">"), F.lit("<headerForm>"), _tag("countyCde", county), _tag("crvNumberId", k), F.lit("</headerForm><propertyForm>"),
        _tag("county", F.when(_every(k, 19), F.lit("88")).when(_every(k, 23), F.lit("  ")).when(_every(k, 2), county)), _tag("whatIsIncludedInSale", note), _tag("newBuildingsOnSaleYear", F.when(_every(k, 3), "Y").when(_every(k, 5), "maybe").otherwise("0")),
        F.col("parcel"), F.lit("<mnPropertyAddresses>"), _tag("id", F.lit(1)), _tag("city", F.concat(F.lit(" City "), (F.col("o_custkey") % 9).cast("string"))), F.lit("</mnPropertyAddresses>"), F.col("use_again" if again else "use"),
        F.lit("</propertyForm><salesAgreementForm>"), _tag("deedContractDate", day), _tag("totPurchaseAmt", price), _tag("sellerPdPts", points), _tag("deedTypeCde", deed), _tag("personalPropertyIncludedInTotal", F.when(_every(k, 2), "true").otherwise("false")), money,
        F.when(_every(k, 8), none).otherwise(F.col("goods")) if again else F.col("goods"), F.lit("</salesAgreementForm><supplementaryForm>"), _tag("relatedInd", F.when(_every(k, 14), "yes").when(_every(k, 2), "no")), _tag("giftInd", F.lit("false")), F.lit("</supplementaryForm></"), root, F.lit(">"),
    )


def _bytes_of(form: str) -> Column:
    return F.when(_every(F.col("o_orderkey"), 73), F.encode(form, "ISO-8859-1")).otherwise(F.col(form).cast("binary"))


def _members(spark, sf: str) -> DataFrame:
    """(archive, ordinal, name, bytes, content): a member for each order, its line items as child rows."""
    k = F.col("o_orderkey")
    o = _orders(spark, sf).withColumn("form", _form(False)).withColumn("content", _bytes_of("form"))
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("archive"), k.cast("int").alias("ordinal"), F.concat(F.lpad((k % 90).cast("string"), 2, "0"), F.lit("_"), k.cast("string"), F.lit(".xml")).alias("name"), F.octet_length("content").cast("long").alias("bytes"), "content")


def _two_extracts(spark, sf: str) -> DataFrame:
    """(extract, content, repeated): the members of extracts 1 and 2, and whether both hold the same bytes. Extract 2 differs
    in the deed (every 5th), the points (every 7th), the personal property (every 8th) and the uses (every 9th)."""
    o = _orders(spark, sf).withColumns({"form_1": _form(False), "form_2": _form(True)}).select(_bytes_of("form_1").alias("b1"), _bytes_of("form_2").alias("b2"))
    both = [F.struct(F.lit(v).alias("extract"), F.col(f"b{v}").alias("content"), F.col("b1").eqNullSafe(F.col("b2")).alias("repeated")) for v in (1, 2)]
    return o.select(F.inline(F.array(*both)))


_MALFORMED = "(k % 59 = 0 or (k % 61 = 0 and k % 11 <> 0 and k % 13 <> 0))"
#: What the rules make of each order: the issue, and the texts of the valid ones.
_TOLD = f"""r as (select o_orderkey as k, o_custkey, o_totalprice, cast(o_orderdate as date) as d, lpad(cast(o_orderkey % 90 as varchar), 2, '0') as county from orders),
i as (select *, case when k % 67 = 0 and k % 59 <> 0 then 'unsupported_declared_encoding' when k % 71 = 0 and k % 59 <> 0 and k % 67 <> 0 then 'unsupported_dtd_or_entity' when {_MALFORMED} then 'malformed_xml' when k % 83 = 0 then 'unsupported_root'
 when k % 90 not between 1 and 87 or (k % 37 = 0 and k % 90 < 10) then 'invalid_transaction_key' when k % 19 = 0 then 'county_mismatch' when k % 29 = 0 or k % 31 = 0 then 'invalid_sale_date'
 when k % 17 = 0 then 'missing_required_amount' when k % 47 = 0 and k % 41 <> 0 and k % 43 <> 0 then 'invalid_amount' when k % 53 = 0 and k % 41 <> 0 and k % 43 <> 0 then 'nonpositive_sale_price' when k % 79 = 0 then 'invalid_amount' else '' end as issue_code from r),
v as (select *, 'MN:ecrv:' || county || ':' || k as source_key from i where issue_code = '')"""
_PRICE = "case when k % 41 = 0 then '0.5' when k % 43 = 0 then '1E+5' else printf('%.4f', o_totalprice) end"
#: What is not read as UTF-8: the accented text that no other note stands in for.
_OLD = "(k % 73 = 0 and k % 11 <> 0 and k % 13 <> 0 and k % 61 <> 0)"


@query(f"""with {_TOLD} select i.k as ordinal, i.issue_code, source_key, case when source_key is not null then strftime(i.d, '%Y-%m-%d') end as sale_date, case when source_key is not null then {_PRICE.replace('k %', 'i.k %').replace('o_totalprice', 'i.o_totalprice')} end as gross_sale_price,
 case when source_key is not null and i.k % 4 = 0 then cast(i.k % 1000 as varchar) end as seller_paid_points, case when source_key is not null then case when i.k % 10 = 0 then 'QUITCLAIM' when i.k % 6 <> 0 then 'LIMWARRNTY' end end as deed_type,
 case when source_key is not null then case when i.k % 11 = 0 then 'a' || chr(65533) || 'b' when i.k % 13 = 0 then 'ab' when i.k % 73 = 0 then 'café' else 'ok' end end as what_included,
 case when source_key is not null then case when i.k % 3 = 0 then true when i.k % 5 = 0 then null else false end end as new_buildings_sale_year, case when source_key is not null then case when i.k % 14 = 0 then true when i.k % 2 = 0 then false end end as related
 from i left join v on i.k = v.k""")
def xml_transactions(spark, sf):
    """Every member with its issue, and the fields of the valid ones."""
    r = XML.parse_members(_members(spark, sf))
    return r.select("ordinal", "issue_code", "source_key", "sale_date", "gross_sale_price", "seller_paid_points", "deed_type", "what_included", "new_buildings_sale_year", "related")


@query(f"""with {_TOLD}, x as (select case when k % 3 = 0 then 'schema3_flat_2020_11_plus' when k % 2 = 0 and exists (select 1 from lineitem where l_orderkey = k and l_returnflag = 'A') then 'legacy_2015_property_codes' when k % 10 = 0 or k % 6 <> 0 then 'legacy_tiered_with_deed_type_2019_08_to_2020_11' else 'legacy_tiered_2016_to_2019_08' end as schema_variant,
 case when {_OLD} then 'cp1252' else 'utf-8' end as encoding, case when {_OLD} then 'cp1252' when k % 11 = 0 then 'invalid_numeric_reference' when k % 13 = 0 then 'invalid_literal_character' end as recovery_method from v)
 select schema_variant, encoding, recovery_method, count(*) as records from x group by all""")
def xml_schema_variants(spark, sf):
    r = XML.parse_members(_members(spark, sf)).where("issue_code = ''")
    return r.groupBy("schema_variant", "encoding", "recovery_method").agg(F.count(F.lit(1)).alias("records"))


def _child(name: str):
    def rows(spark, sf):
        return XML.child_table(XML.parse_members(_members(spark, sf)), name)

    rows.__name__ = f"xml_{name}"
    rows.__doc__ = f"The records' {name} as a table."
    return rows


_USE = """case when l_returnflag = 'A' then 'before' else 'planned' end as use_timing, cast(l_linenumber as varchar) as id, case when not code and l_linenumber < 5 then 'RESID' when not code then 'COMM' end as tier1Cde, case when not code then 'SINGLEFAM' end as tier2Cde, cast(null as varchar) as tier3Cde, cast(null as varchar) as primaryInd,
 case when code and l_linenumber < 3 then 'RES' when code then 'COM' end as propertyTypeCode, case when code then 'HOUSESGL' end as propertyUseCode"""

xml_parcels = query(f"""with {_TOLD} select source_key, row_number() over (partition by source_key order by l_linenumber, l_partkey || '<')::int as ordinal, case when l_linenumber <> 7 then cast(l_linenumber as varchar) end as id, case when l_linenumber <> 7 then cast(l_partkey as varchar) end as "parcelId", case when l_linenumber = 1 then 'true' end as "primary" from v join lineitem on l_orderkey = k""")(_child("parcels"))
xml_addresses = query(f"""with {_TOLD} select source_key, 1 as ordinal, '1' as id, 'City ' || (o_custkey % 9) as city, cast(null as varchar) as street1, cast(null as varchar) as street2, cast(null as varchar) as zip from v""")(_child("addresses"))
xml_uses = query(f"""with {_TOLD}, u as (select source_key, k % 3 <> 0 and k % 2 = 0 as code, lineitem.* from v join lineitem on l_orderkey = k where l_returnflag in ('A', 'R')) select source_key, row_number() over (partition by source_key order by l_returnflag, l_linenumber)::int as ordinal, {_USE} from u""")(_child("uses"))
xml_financing = query(f"""with {_TOLD} select source_key, 1 as ordinal, cast(k as varchar) as id, 'true' as selected, cast(o_custkey as varchar) as "contractMortgageAmt", {', '.join(f'cast(null as varchar) as "{c}"' for c in XML.CHILDREN["financing"][1].split()[3:])} from v where k % 2 = 0""")(_child("financing"))
_GOODS = """select source_key, row_number() over (partition by source_key order by l_linenumber, printf('%.2f', l_extendedprice) || '<')::int as ordinal, cast(l_linenumber as varchar) as id, case when l_linenumber % 2 = 1 then 'true' else 'no' end as selected, cast(null as varchar) as "propertyDescription", case when l_linenumber <> 4 then printf('%.2f', l_extendedprice) end as "propertyValue" from v join lineitem on l_orderkey = k where l_linestatus = 'F'"""
xml_personal_property = query(f"with {_TOLD} {_GOODS}")(_child("personal_property"))


@query(f"""with {_TOLD}, f as (select k, count(*) filter (l_linestatus = 'F') as goods, count(*) filter (l_returnflag = 'A') as uses from v left join lineitem on l_orderkey = k group by 1),
 x as (select v.k, list_filter([case when v.k % 5 = 0 then 'deed_type' end, case when v.k % 28 = 0 then 'seller_paid_points' end, case when v.k % 8 = 0 and goods > 0 then 'child_personal_property' end, case when v.k % 9 = 0 and uses > 0 then 'child_uses' end], lambda x: x is not null) as f from v join f on v.k = f.k)
 select field, count(*) as records from (select unnest(list_append(f, 'any_revision')) as field from x where len(f) > 0) group by 1""")
def record_revisions(spark, sf):
    """Fields and child tables in which a record's second version differs from its first."""
    # the same bytes are the same version: such a member has no revision, whatever its record says
    members = _two_extracts(spark, sf).where("not repeated").drop("repeated")
    digests = {f"{c}_digest": f"child_{c}" for c in XML.CHILDREN}
    versions = XML.parse_members(members, fields=[*XML.TRANSACTION, *digests, "issue_code"]).where("issue_code = ''").withColumnsRenamed(digests)
    parts = [*[c for c in XML.TRANSACTION if c != "source_key"], *digests.values()]
    pairs = J.first_and_last(versions.repartition("source_key"), "source_key", [F.col("extract")], parts)
    return V.revised_fields(pairs, "source_key", parts).where("field <> 'unexplained'").groupBy("field").agg(F.count(F.lit(1)).alias("records"))


_COUNTIES = [(f"{i:02d}", f"County {i % 7}", str(27000 + i)) for i in range(1, 88)]


@query(f"""with {_TOLD}, b as (select source_key, bool_and(case when k % 3 <> 0 and k % 2 = 0 then l_linenumber < 3 else l_linenumber < 5 end) as single_family from v join lineitem on l_orderkey = k and l_returnflag = 'A' group by 1),
 p as (select source_key, count(distinct l_partkey) filter (l_linenumber <> 7) + count(distinct case when l_linenumber = 7 then 1 end) as parcel_count from v join lineitem on l_orderkey = k group by 1), g as ({_GOODS}),
 s as (select source_key, sum(cast(cast("propertyValue" as double) as decimal(18,4)))::double as total, bool_and("propertyValue" is not null) as complete from g where selected = 'true' group by 1),
 x as (select v.*, single_family as sf, parcel_count, {_PRICE} as price, case when k % 4 = 0 then (k % 1000)::double end as points, k % 2 = 0 as included, coalesce(total, 0) as total, coalesce(complete, false) as complete from v left join b using (source_key) left join p using (source_key) left join s using (source_key))
 select source_key, strftime(d, '%Y-%m-%d') as sale_date, 'County ' || (county::int % 7) as county, (27000 + county::int)::varchar as county_fips, price::double as gross_sale_price, sf as single_family, parcel_count::int as parcel_count,
 case when not included or complete then case when included then total else 0 end end as personal_property_total,
 case when (not included or complete) and points >= 0 and price::double - case when included then total else 0 end - points > 0 then price::double - case when included then total else 0 end - points end as adjusted_price,
 concat_ws(';', case when not (price::double > 10000 and price::double <= 200000) then 'price_out_of_bounds' end, case when k % 14 = 0 then 'related' end, case when k % 10 = 0 then 'quitclaim' end) as exclusion_reasons_current,
 case when k % 10 = 0 then 'QUITCLAIM' when k % 6 <> 0 then 'LIMWARRNTY' end as deed_type from x where year(d) between 1996 and 2000""")
def second_state_from_records(spark, sf):
    """The harmonised contract of the years 1996 to 2000 straight from XML members."""
    counties = spark.createDataFrame(_COUNTIES, "code string, name string, fips string")
    needed = ["source_key", "mn_county_code", "sale_date", "sale_year", "gross_sale_price", "seller_paid_points", "deed_type", "personal_property_included", *C.DISQUALIFYING, "uses", "parcels", "personal_property", "issue_code"]
    valid = XML.parse_members(_members(spark, sf).select("content"), fields=needed).where("issue_code = ''")
    records = XML.with_counties(valid, counties).withColumn("revision_conflict", F.lit(False))
    wanted = ["source_key", "sale_date", "county", "county_fips", "gross_sale_price", "single_family", "parcel_count", "personal_property_total", "adjusted_price", "exclusion_reasons_current", "deed_type"]
    return C.prepare_second_records(records, first=1996, last=2000, counties=[f"County {i}" for i in range(7)], urban=["County 0"], floor=10_000, cap=200_000, columns=wanted)
