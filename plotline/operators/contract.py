"""The harmonised sale contract: component-adjusted price, reporting lag and maturity, use classes, exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions import expr as X
from plotline.operators.aggs import exact_sum, for_all, higher
from plotline.operators.joins import assert_unique
from plotline.sources.scratch import cut


def coerce(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """The contract's columns in order and type; values that do not fit become null, absent columns raise."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {', '.join(missing)}")
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in contract.items()])


def adjusted_price(gross: Column, points: Column, included: Column, personal: Column, personal_complete: Column) -> Column:
    """gross - seller-paid points - included personal property, where these are known and the result is positive."""
    goods = F.when(included, F.when(personal_complete, personal)).when(~included, F.lit(0.0))
    net = gross - goods - points
    return F.when(net > 0, net)


def reporting(sales: DataFrame, *, key: str, sale_date: str, first_extract: str, p: float = 0.95) -> DataFrame:
    """Adds lag_days, maturity_days (order statistic at or above ``p`` of the lags from 0) and recent (sold within the
    maturity of the last extract)."""
    d = sales.withColumn("lag_days", F.datediff(first_extract, sale_date))
    lags = d.where("lag_days >= 0").select(F.lit(1).alias("g"), "lag_days")
    counts = lags.groupBy("g", "lag_days").agg(F.count(F.lit(1)).alias("c"))  # a row per distinct lag
    total = counts.agg(F.sum("c").alias("n"))
    run = F.sum("c").over(Window.partitionBy("g").orderBy("lag_days"))
    m = counts.withColumn("run", run).crossJoin(total).where(F.col("run") > higher(p)).agg(F.min("lag_days").alias("maturity_days"))
    last = d.agg(F.max(first_extract).alias("_last"))
    return d.crossJoin(m).crossJoin(last).withColumn("recent", F.col(sale_date) > F.date_sub("_last", F.col("maturity_days"))).drop("_last")


def use_summary(uses: DataFrame, key: str, timing: str, before: str, single_family: Column, evidence: Column) -> DataFrame:
    """Per key over the rows before the sale: rows, whether all are single-family (rows without evidence are skipped;
    none at all counts as yes), and the sorted evidence codes."""
    return uses.where(F.col(timing) == before).groupBy(key).agg(F.count(F.lit(1)).alias("uses"), for_all(single_family, True).alias("all_single_family"), F.array_join(F.array_sort(F.collect_set(evidence)), ";").alias("evidence"))


def personal_summary(goods: DataFrame, key: str, selected: Column, value: str) -> DataFrame:
    """Per key over the selected rows: rows, sum, and whether every value is known and not negative."""
    ok = F.coalesce(F.col(value) >= 0, F.lit(False))
    return goods.where(selected).groupBy(key).agg(F.count(F.lit(1)).alias("items"), exact_sum(F.col(value)).alias("total"), F.bool_and(ok).alias("complete"))


#: The two-state contract's columns in order, by type.
CONTRACT = {
    c: kind
    for kind, names in (
        ("string", "source_key source_state source_schema source_snapshot source_version sale_date"), ("int", "sale_year"), ("string", "sale_month county county_fips metro tier_type"),
        ("double", "gross_sale_price adjusted_price personal_property_total seller_paid_points"), ("int", "parcel_count"), ("string", "property_type_evidence"),
        ("boolean", "single_family eligible_current_study eligible_strict_comparable strict_eligibility_available research_eligible"),
        ("string", "exclusion_reasons_current exclusion_reasons_strict exclusion_reasons_research"), ("boolean", "source_status_conflict revision_conflict parse_recovered"), ("string", "recovery_method deed_type"),
        ("boolean", "contract_for_deed trustee_deed probate_deed limited_warranty_deed new_construction"), ("int", "reporting_lag_days reporting_maturity_days"), ("boolean", "recent_reporting_period"), ("string", "regime"),
    )
    for c in names.split()
}
#: Eras by year, both ends included.
ERAS = (("BASELINE", 2015, 2019), ("PANDEMIC_LOW_RATE", 2020, 2021), ("HIGH_RATE_LOCK_IN", 2022, 2025))
#: Answers that exclude a sale of the second state, in rule order.
DISQUALIFYING = "related gift government legal_action name_change non_market_price tax_exempt buyer_part_interest deed_payoff like_kind_exchange received_in_trade".split()


def _filled(df: DataFrame, given: Mapping[str, Column]) -> DataFrame:
    """The contract's columns in order and type; those not given are null, FIPS codes have five digits."""
    out = df.select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in CONTRACT.items()])
    return out.withColumn("county_fips", F.when(F.length("county_fips") < 5, F.lpad("county_fips", 5, "0")).otherwise(F.col("county_fips")))


def _known_counties(df: DataFrame, county: str, counties: Sequence[str]) -> Column:
    """The county, which raises when it is read and is none of ``counties`` (null is let through)."""
    c = F.col(county)
    return F.when(c.isNull() | c.isin(list(counties)), c).otherwise(F.raise_error(F.concat(F.lit("county outside the study area: "), c)))


def prepare_first_state(history: DataFrame, *, first: int, last: int, counties: Sequence[str], state: str = "IN", eras=ERAS) -> DataFrame:
    """Contract rows of the flat-file history (`disclosures.combine_sources`) of the years ``first`` to ``last``. Strict
    eligibility is known where no status conflicts and all three status answers are there."""
    flags = {c: X.flag(F.col(c), words=True) for c in ("all_parcels_single_family", "eligible_current_study", "eligible_strict_comparable", "source_status_conflict", "validation_complete", "valid_for_trending", "all_parcels_improved_residential")}
    known = ~F.coalesce(flags["source_status_conflict"], F.lit(False))
    for c in ("validation_complete", "valid_for_trending", "all_parcels_improved_residential"):
        known = known & flags[c].isNotNull()
    reasons = X.reasons([("not_current_study_eligible", ~flags["eligible_current_study"]), ("not_single_family", ~flags["all_parcels_single_family"])], True)
    given = {c: F.col(c) for c in "source_key sale_date sale_year sale_month county_fips metro tier_type gross_sale_price parcel_count".split()} | {
        "source_state": F.lit(state), "source_schema": F.col("source_format"), "source_snapshot": F.col("source_file"), "county": _known_counties(history, "county", counties), "property_type_evidence": F.col("property_class_codes"),
        "single_family": flags["all_parcels_single_family"], "eligible_current_study": flags["eligible_current_study"], "eligible_strict_comparable": flags["eligible_strict_comparable"], "strict_eligibility_available": known,
        "exclusion_reasons_current": F.coalesce("exclusion_reasons_current", F.lit("")), "exclusion_reasons_strict": F.coalesce("exclusion_reasons_strict", F.lit("")), "source_status_conflict": flags["source_status_conflict"],
        "revision_conflict": F.lit(False), "parse_recovered": F.lit(False), "recent_reporting_period": F.lit(False), "exclusion_reasons_research": reasons, "research_eligible": X.eligible(reasons), "regime": X.regime(F.col("sale_year"), eras),
    }
    return _filled(history.where(F.col("sale_year").between(first, last)), given)


def evidence(legacy: Sequence[Column], modern: Sequence[Column]) -> Column:
    """The codes of both forms of a use row: each form's joined by ':', the two by '|', absent ones left out."""
    one = lambda parts: F.trim(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]), F.lit(":"))
    return F.concat_ws("|", *[F.nullif(one(parts), F.lit("")) for parts in (legacy, modern)])


def _family(row: Column) -> Column:
    """Whether a use row is of a single-family house, in either form; unknown is no."""
    old, new = (row["propertyTypeCode"] == "RES") & (row["propertyUseCode"] == "HOUSESGL"), (row["tier1Cde"] == "RESID") & (row["tier2Cde"] == "SINGLEFAM")
    return F.coalesce(old | new, F.lit(False))


def _codes(row: Column) -> Column:
    return evidence([row["propertyTypeCode"], row["propertyUseCode"]], [row["tier1Cde"], row["tier2Cde"]])


#: The contract's columns that a state's reporting gives.
REPORTING = ("reporting_lag_days", "reporting_maturity_days", "recent_reporting_period")


def _in_second_state(sales: DataFrame, first: int, last: int) -> DataFrame:
    return sales.where(X.flag(F.col("is_twin_cities"), words=True) & F.col("sale_year").between(first, last))


def _second_state(d: DataFrame, counties: Sequence[str], urban: Sequence[str], state: str, metro: str, eras, floor: float, cap: float) -> dict[str, Column]:
    """The contract's columns of sales with what their child rows sum up to (single_family, property_type_evidence,
    parcel_count, items, total, complete), but for those of REPORTING."""
    flag = lambda c: X.flag(F.col(c), words=True)
    price, deed = F.col("gross_sale_price").try_cast("double"), F.upper("deed_type")
    shared = [("price_out_of_bounds", ~F.coalesce(X.in_bounds(price, floor, cap), F.lit(False))), ("revision_conflict", F.coalesce(flag("revision_conflict"), F.lit(True)))]
    quitclaim = ("quitclaim", deed == "QUITCLAIM")
    current = X.reasons([*shared, *[(f, flag(f)) for f in DISQUALIFYING], quitclaim], False)
    strict = X.reasons([*shared, *[(f"{f}_or_unknown", F.coalesce(flag(f), F.lit(True))) for f in DISQUALIFYING], quitclaim, ("deed_type_unknown", deed.isNull())], False)
    research = F.concat_ws(";", F.nullif(current, F.lit("")), F.when(~F.coalesce("single_family", F.lit(False)), F.lit("not_single_family")))
    known = deed.isNotNull()
    for f in DISQUALIFYING:
        known = known & flag(f).isNotNull()
    included, points = flag("personal_property_included"), F.col("seller_paid_points").try_cast("double")
    complete = F.coalesce(~included | (included & (F.coalesce("items", F.lit(0)) > 0) & F.coalesce("complete", F.lit(False))), F.lit(False))
    sold = F.when(included, F.coalesce("total", F.lit(0.0))).otherwise(F.lit(0.0))
    net = price - sold - F.coalesce(points, F.lit(0.0))
    return {c: F.col(c) for c in "source_key sale_date sale_year sale_month county_fips single_family property_type_evidence parcel_count recovery_method".split()} | {
        "source_state": F.lit(state), "source_schema": F.col("schema_variant"), "source_snapshot": F.concat("archive_name", F.lit("@"), "extract_timestamp"), "source_version": F.col("version_id"), "county": _known_counties(d, "county_name", counties),
        "metro": F.lit(metro), "tier_type": F.when(F.col("county_name").isin(list(urban)), "URBAN_CORE").otherwise("SUBURBAN_COLLAR"), "gross_sale_price": price, "seller_paid_points": points,
        "personal_property_total": F.when(complete, sold), "adjusted_price": F.when(complete & (points >= 0) & (net > 0), net), "source_status_conflict": F.lit(False), "revision_conflict": flag("revision_conflict"), "parse_recovered": flag("parse_recovered"),
        "deed_type": deed, "contract_for_deed": deed == "CONFORDEED", "trustee_deed": deed == "TRUSTEE", "probate_deed": deed.isin("PROBATE", "PERREPDEED"), "limited_warranty_deed": deed == "LIMWARRNTY", "new_construction": flag("new_buildings_sale_year"),
        "exclusion_reasons_current": current, "exclusion_reasons_strict": strict, "exclusion_reasons_research": research, "eligible_current_study": X.eligible(current), "eligible_strict_comparable": X.eligible(strict),
        "strict_eligibility_available": known, "research_eligible": X.eligible(research), "regime": X.regime(F.col("sale_year"), eras),
    }


def _reported(d: DataFrame) -> dict[str, Column]:
    return {"reporting_lag_days": F.col("lag_days"), "reporting_maturity_days": F.coalesce("maturity_days", F.lit(0)), "recent_reporting_period": F.col("recent")}


def prepare_second_state(sales: DataFrame, uses: DataFrame, parcels: DataFrame, goods: DataFrame, *, first: int, last: int, counties: Sequence[str], urban: Sequence[str], state: str = "MN", metro: str = "MSP", eras=ERAS, floor: float = X.PRICE_FLOOR, cap: float = X.PRICE_CAP) -> DataFrame:
    """Contract rows of the record exports of the years ``first`` to ``last`` inside the metropolitan area. Child tables
    are summed up per sale before they are joined; a source key that occurs twice raises."""
    own = assert_unique(_in_second_state(sales, first, last), ["source_key"], "sales")
    row = {c: F.col(c) for c in ("propertyTypeCode", "propertyUseCode", "tier1Cde", "tier2Cde")}
    before = uses.where(F.lower("use_timing") == "before").select("source_key", _family(row).alias("family"), _codes(row).alias("codes"))
    before = before.groupBy("source_key").agg(F.bool_and("family").alias("single_family"), F.array_join(F.array_sort(F.collect_set("codes")), ";").alias("property_type_evidence"))
    plots = parcels.select("source_key", "parcelId").distinct().groupBy("source_key").agg(F.count(F.lit(1)).alias("parcel_count"))
    value = F.col("propertyValue").try_cast("double")
    things = personal_summary(goods.select("source_key", X.flag(F.col("selected"), words=True).alias("chosen"), value.alias("value")), "source_key", F.col("chosen"), "value")
    d = own.join(before, "source_key", "left").join(plots, "source_key", "left").join(things, "source_key", "left")
    d = reporting(d.withColumns({"_day": F.to_date("sale_date"), "_seen": F.to_date(F.to_timestamp("first_extract_timestamp"))}), key="source_key", sale_date="_day", first_extract="_seen")
    return _filled(d, _second_state(d, counties, urban, state, metro, eras, floor, cap) | _reported(d))


def prepare_second_records(records: DataFrame, *, first: int, last: int, counties: Sequence[str], urban: Sequence[str], columns: Sequence[str] = tuple(CONTRACT), state: str = "MN", metro: str = "MSP", eras=ERAS, floor: float = X.PRICE_FLOOR, cap: float = X.PRICE_CAP) -> DataFrame:
    """`prepare_second_state` of sales that hold their child rows themselves (uses, parcels and personal_property as
    `xml_records.parse_members` gives them): they are summed up where they are and nothing is joined. ``columns`` are the
    contract's columns to return; records need what these are made from only. Each record is read once: its row is
    written (`scratch.cut`) before the keys are checked and the reporting is counted."""
    own = _in_second_state(records, first, last)
    before = lambda r: F.coalesce(F.lower(r["use_timing"]) == "before", F.lit(False))
    value = lambda r: r["propertyValue"].try_cast("double")
    total = F.aggregate("_chosen", F.lit(0).cast("decimal(28,4)"), lambda sofar, r: (sofar + F.coalesce(value(r).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))).cast("decimal(28,4)"))
    d = own.withColumns({
        "single_family": F.when(F.exists("uses", before), F.forall("uses", lambda r: ~before(r) | _family(r))),
        "property_type_evidence": F.when(F.exists("uses", before), F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("uses", before), _codes))), ";")),
        "parcel_count": F.nullif(F.size(F.array_distinct(F.transform("parcels", lambda r: r["parcelId"]))), F.lit(0)),
        "_chosen": F.filter("personal_property", lambda r: X.flag(r["selected"], words=True)),
    })
    d = d.withColumns({"items": F.size("_chosen"), "total": total.cast("double"), "complete": F.forall("_chosen", lambda r: F.coalesce(value(r) >= 0, F.lit(False)))})
    given = _second_state(d, counties, urban, state, metro, eras, floor, cap)
    wanted = [c for c in CONTRACT if c in columns]
    timed = any(c in REPORTING for c in wanted)
    kept = [given[c].alias(c) for c in given if c in wanted or c == "source_key"]
    days = [F.to_date("sale_date").alias("_day"), F.to_date(F.to_timestamp("first_extract_timestamp")).alias("_seen")] if timed else []
    d = assert_unique(cut(d.select(*kept, *days), "records"), ["source_key"], "sales")
    if timed:
        d = reporting(d, key="source_key", sale_date="_day", first_extract="_seen")
    return _filled(d, {c: F.col(c) for c in wanted if c not in REPORTING} | (_reported(d) if timed else {})).select(*[c for c in columns])
