"""Raw disclosure tables to one row per transaction: two flat-file layouts, eligibility, and their union by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.functions import expr as X
from plotline.operators.aggs import first_valid, for_all, joined_distinct
from plotline.operators.dedup import dispositions

# The headers that hold each flag, by layout; None where a layout has no such answer.
LEGACY_FLAGS = {
    "validation_complete": "P2_17_Validation_Complete", "valid_for_trending": "P2_16_Valid_Trending", "valuable_consideration": None, "vacant_land": "B3_Vacant_Land_Assessor", "trade": "B4_Trade_Assessor",
    "related_party": "B7_Relationship_Assessor", "land_contract": "B8_Land_Contract_Assessor", "partial_interest": "B11_Partial_Interest_Assessor", "charity_transfer": "B14_Charity_Assessor",
    "sheriff_sale": "Foreclosure", "short_sale": None, "quitclaim": "Quitclaim",
}
MODERN_FLAGS = {
    "validation_complete": "P2_17_Validation_Complete", "valid_for_trending": "P2_16_Valid_Trending", "valuable_consideration": "B1_Valuable_Consider", "residential_property": "C10_Residential_Property",
    "agricultural_property": "C10_Agricultural_Property", "commercial_property": "C10_Commercial_Property", "industrial_property": "C10_Industrial_Property", "vacant_land": None, "trade": "B4_Trade",
    "related_party": None, "land_contract": None, "partial_interest": "B6_Partial_Interest", "charity_transfer": "B10_Charity", "sheriff_sale": "C1_Sheriff_Sale", "short_sale": "C2_Short_Sale", "quitclaim": "C3_Quitclaim",
}
USES = ("residential", "agricultural", "commercial", "industrial")
#: The contract's columns before eligibility, in order.
COLUMNS = (
    "source_key source_format source_year source_file sdf_id county_dlgf_code county county_fips metro tier_type sale_date sale_year sale_month gross_sale_price property_zip parcel_count "
    "property_class_codes dom_reported validation_complete valid_for_trending valuable_consideration residential_property agricultural_property commercial_property industrial_property vacant_land "
    "trade related_party land_contract partial_interest charity_transfer sheriff_sale short_sale quitclaim all_parcels_improved_residential all_parcels_single_family source_status_conflict"
).split()
STATUS = ("validation_complete", "valid_for_trending")
#: Columns that must agree for rows of one key to be the same transaction.
CORE = tuple(c for c in COLUMNS if c not in {"source_key", "source_year", "source_file", "source_status_conflict", *STATUS})


def _shared(df: DataFrame, kind: str, year: int | Column, file: str | Column, date: str, price: str, divisor: int, counties: Mapping[str, tuple[str, str, str]], metro: str) -> dict[str, Column]:
    """Columns that both layouts derive in one way. ``counties``: code -> (county, fips, tier type)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    key = F.trim(F.col("SDF_ID").cast("string"))
    code = F.trim(F.col("County_ID").cast("string"))
    code = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
    day = X.mixed_date(F.col(date))
    place = {n: X.lookup(code, {k: v[i] for k, v in counties.items()}) for i, n in enumerate(("county", "county_fips", "tier_type"))}
    return place | {
        "source_key": X.source_key(key, "IN:SDF:"), "source_format": F.lit(kind), "source_year": lit(year).cast("int"), "source_file": lit(file), "sdf_id": key, "county_dlgf_code": code, "metro": F.lit(metro),
        "sale_date": F.date_format(day, "yyyy-MM-dd"), "sale_year": F.year(day), "sale_month": F.date_format(day, "yyyy-MM"), "gross_sale_price": X.number(F.col(price), divisor), "source_status_conflict": F.lit(False),
    }


def _flags(df: DataFrame, table: Mapping[str, str | None]) -> dict[str, Column]:
    return {name: F.lit(None).cast("boolean") if header is None else X.flag(X.optional(df, header)) for name, header in table.items()}


def _contract(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select(*[columns[c].alias(c) for c in COLUMNS])


def normalize_legacy(df: DataFrame, *, year: int | Column, file: str | Column, counties: Mapping[str, tuple[str, str, str]], metro: str = "INDY") -> DataFrame:
    """Contract rows of a legacy table, one per transaction already: uses and single family follow from the one property
    class, questions that the form did not ask are null, and an absent class is neither improved nor single-family."""
    kind = F.trim(F.col("P2_6_Prop_Class_Code").cast("string"))
    told = X.property_class(kind)
    parcels = [F.col(c).isNotNull().cast("int") for c in ("Parcel1", "Parcel2", "Parcel3") if c in df.columns]
    own = {
        "property_zip": X.zip5(F.col("PropZip")), "parcel_count": sum(parcels, F.lit(0)), "property_class_codes": F.nullif(kind, F.lit("")), "dom_reported": F.lit(None).cast("long"),
        "all_parcels_improved_residential": F.coalesce(told["improved"], F.lit(False)), "all_parcels_single_family": F.coalesce(told["single_family"], F.lit(False)),
    } | {f"{u}_property": F.coalesce(told[u], F.lit(False)) for u in USES}
    return _contract(df, _shared(df, "legacy_pipe_v1", year, file, "Conveyance_Date", "C6_Sales_Price", 1, counties, metro) | _flags(df, LEGACY_FLAGS) | own)


def summarize_parcels(parcels: DataFrame) -> DataFrame:
    """One row per SDF_ID over its distinct parcel rows: count, first valid ZIP by instance number (unnumbered last, ties
    to the smaller ZIP), distinct classes, and whether all known classes are improved and single-family (none: no)."""
    kind = F.nullif(F.trim(F.col("P2_6_Prop_Class_Code").cast("string")), F.lit(""))
    p = parcels.distinct().select("SDF_ID", X.number(F.col("Parcel_Instance_No")).alias("nth"), X.zip5(F.col("A5_ZipCode")).alias("zip"), kind.alias("kind"))
    told = X.property_class(F.col("kind"))
    return p.groupBy("SDF_ID").agg(
        F.count(F.lit(1)).cast("int").alias("parcel_count"), first_valid(F.col("zip"), F.col("nth").isNull(), F.col("nth"), F.col("zip")).alias("property_zip"), F.nullif(joined_distinct(F.col("kind")), F.lit("")).alias("property_class_codes"),
        for_all(told["improved"], False).alias("all_parcels_improved_residential"), for_all(told["single_family"], False).alias("all_parcels_single_family"),
    )


def normalize_modern(sales: DataFrame, parcels: DataFrame, *, year: int | Column, file: str | Column, counties: Mapping[str, tuple[str, str, str]], metro: str = "INDY") -> DataFrame:
    """Contract rows of a modern pair of tables: prices are in cents, parcels are joined as one summary row a sale."""
    j = sales.join(summarize_parcels(parcels), "SDF_ID", "left")
    own = {c: F.col(c) for c in ("property_zip", "parcel_count", "property_class_codes")} | {"dom_reported": X.number(X.optional(sales, "C8_Market_Days")).cast("long")}
    own |= {c: F.coalesce(c, F.lit(False)) for c in ("all_parcels_improved_residential", "all_parcels_single_family")}
    return _contract(j, _shared(j, "modern_multifile_v1", year, file, "C7_Conveyance_Date", "E1_Sales_Price", 100, counties, metro) | _flags(j, MODERN_FLAGS) | own)


def eligibility(df: DataFrame, floor: float = X.PRICE_FLOOR, cap: float = X.PRICE_CAP) -> DataFrame:
    """Adds the two exclusion lists and whether each is empty. Legacy rows need validation and an improved class, modern
    rows the answers on the form; the strict list asks modern rows for validation, trending and parcels as well."""
    is_not = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    legacy = F.col("source_format") == "legacy_pipe_v1"
    price, only = F.col("gross_sale_price"), is_not("residential_property", True)
    for u in USES[1:]:
        only = only | is_not(f"{u}_property", False)
    shared = [
        ("invalid_sale_date", F.col("sale_date").isNull()), ("sale_year_mismatch", F.col("sale_year") != F.col("source_year")), ("invalid_sale_price", price.isNull()),
        ("price_at_or_below_floor", F.coalesce(price <= floor, F.lit(False))), ("price_above_cap", F.coalesce(price > cap, F.lit(False))),
        ("validation_incomplete", legacy & is_not("validation_complete", True)), ("not_valid_for_trending", legacy & is_not("valid_for_trending", True)), ("not_improved_residential", legacy & is_not("all_parcels_improved_residential", True)),
        ("not_valuable_consideration", ~legacy & is_not("valuable_consideration", True)), ("not_residential_only", ~legacy & only),
        *[(f"{c}_or_unknown", ~legacy & is_not(c, False)) for c in ("sheriff_sale", "short_sale", "quitclaim")],
    ]
    strict = [
        ("source_status_conflict", ~legacy & F.col("source_status_conflict")), ("validation_incomplete", ~legacy & is_not("validation_complete", True)), ("not_valid_for_trending", ~legacy & is_not("valid_for_trending", True)),
        ("missing_parcel", ~legacy & F.coalesce(F.col("parcel_count") <= 0, F.lit(True))), ("not_all_parcels_improved_residential", ~legacy & is_not("all_parcels_improved_residential", True)),
    ]
    out = df.withColumns({"exclusion_reasons_current": X.reasons(shared, True), "exclusion_reasons_strict": X.reasons([*shared, *strict], True)})
    return out.withColumns({"eligible_current_study": X.eligible(F.col("exclusion_reasons_current")), "eligible_strict_comparable": X.eligible(F.col("exclusion_reasons_strict"))})


def combine_sources(rows: DataFrame, *, key: str = "source_key", source: str = "source_year", core: Sequence[str] = CORE, status: Sequence[str] = STATUS, conflict: str = "source_status_conflict", prefer: Sequence = (), decide=eligibility) -> tuple[DataFrame, DataFrame]:
    """(history, disposed). Repeated keys are settled inside each source first; ``decide`` is then applied to what is
    kept; keys that still occur in several sources are settled once more, with their decisions as they are. ``disposed``
    has every row of both steps (step, disposition, kept): a raw row is dropped in one of them or is in the history."""
    order = [*prefer] or [F.desc_nulls_last(F.col("sale_year") == F.col("source_year")), F.desc_nulls_last("source_year"), F.asc_nulls_last("source_file"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])]
    settle = lambda d, scope: dispositions(d, key=key, core=core, status=status, prefer=order, scope=scope)
    mark = lambda d: d.withColumn(conflict, F.coalesce(F.col(conflict), F.lit(False)) | F.col("conflict"))
    first = settle(rows, [source])
    once = decide(mark(first.where("kept")).drop("disposition", "kept", "conflict"))
    second = settle(once, [])
    history = mark(second.where("kept")).drop("disposition", "kept", "conflict")
    told = lambda d, step: d.select(*rows.columns, F.lit(step).alias("step"), "disposition", "kept")
    return history, told(first, 1).unionByName(told(second, 2).where("disposition <> 'unique'"))


def source_funnel(rows: DataFrame, history: DataFrame, disposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: raw rows, rows dropped by kind over both steps, rows of the history, and whether they add up."""
    gone = lambda k: F.count_if((F.col("disposition") == k) & ~F.col("kept"))
    raw = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"))
    lost = disposed.groupBy(*keys).agg(gone("invalid_key").alias("invalid"), gone("exact").alias("exact"), gone("status_variant").alias("variant"), gone("conflict").alias("conflicting"))
    kept = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    f = raw.join(lost, list(keys), "left").join(kept, list(keys), "left").na.fill(0)
    return f.withColumn("balanced", F.col("raw") == F.col("invalid") + F.col("exact") + F.col("variant") + F.col("conflicting") + F.col("kept"))
