"""Column expressions of the disclosure normalisers: flags, codes, dates, bounds, reasons, payments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_FLOOR, PRICE_CAP = 50_000, 15_000_000


def flag(c: Column, words: bool = False) -> Column:
    """Y/YES/1 -> true, N/NO/0 -> false, anything else -> null; with ``words`` TRUE and FALSE count too."""
    yes, no = ["Y", "YES", "1"], ["N", "NO", "0"]
    if words:
        yes, no = [*yes, "TRUE"], [*no, "FALSE"]
    s = F.upper(F.trim(c.cast("string")))
    return F.when(s.isin(yes), F.lit(True)).when(s.isin(no), F.lit(False))


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a typed null where the frame has none of that name."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed map, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def zip5(c: Column, zeros: bool = False) -> Column:
    """Five-digit ZIP: the part before the first '-', without one trailing '.0' (with ``zeros``: a dot and any zeros),
    3 to 5 digits padded to 5; 00000 and anything else is null."""
    s = F.regexp_replace(F.substring_index(F.trim(c.cast("string")), "-", 1), r"\.0*$" if zeros else r"\.0$", "")
    padded = F.when(s.rlike("^[0-9]{3,5}$"), F.lpad(s, 5, "0"))
    return F.when(padded != "00000", padded)


def county_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), r"\s*COUNTY\s*$", ""))


def number(c: Column, divisor: float = 1.0) -> Column:
    """Number of a text, null where it is none, divided (cents to dollars)."""
    return F.expr("1.0D") * c.try_cast("double") / F.lit(float(divisor))


def mixed_date(c: Column) -> Column:
    """Date written MM/dd/yyyy or yyyy-MM-dd, else null."""
    return F.coalesce(F.try_to_date(c, "MM/dd/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def source_key(c: Column, prefix: str) -> Column:
    """prefix + id where the id is letters, digits and '-' only, else null."""
    return F.when(c.rlike("^[A-Za-z0-9-]+$"), F.concat(F.lit(prefix), c))


def property_class(c: Column) -> dict[str, Column]:
    """Flags of a three-digit property class code."""
    patterns = {"improved": "^5[1-9][0-9]$", "single_family": "^51[0-5]$", "residential": "^5[0-9]{2}$", "agricultural": "^[12][0-9]{2}$", "commercial": "^4[0-9]{2}$", "industrial": "^3[0-9]{2}$"}
    return {k: c.rlike(p) for k, p in patterns.items()}


def in_bounds(price: Column, floor: float = PRICE_FLOOR, cap: float = PRICE_CAP) -> Column:
    """Above the floor, up to and including the cap."""
    return (price > floor) & (price <= cap)


def regime(year: Column, eras: Sequence[tuple[str, int, int]] = (("BASELINE", 2015, 2019), ("TRANSITION", 2020, 2021), ("SHOCK", 2022, 2025))) -> Column:
    """Name of the era that the year is in, both ends included, else null."""
    out = F.lit(None).cast("string")
    for name, first, last in reversed(eras):
        out = F.when(year.between(first, last), F.lit(name)).otherwise(out)
    return out


def reasons(rules: Sequence[tuple[str, Column]], unknown_fails: bool) -> Column:
    """Codes of the rules whose condition holds, in rule order, joined by ';'. An unknown condition counts as true with
    ``unknown_fails``, else as false."""
    return F.concat_ws(";", *[F.when(F.coalesce(cond, F.lit(unknown_fails)), F.lit(code)) for code, cond in rules])


def eligible(reason: Column) -> Column:
    return reason == ""


def payment(price: Column, rate_percent: Column, loan_share: float = 0.8, months: int = 360) -> Column:
    """Monthly payment on a fixed-rate loan over ``loan_share`` of the price."""
    r = rate_percent / F.lit(1200.0)
    growth = F.pow(F.lit(1.0) + r, F.lit(float(months)))
    return price * F.lit(loan_share) * r * growth / (growth - F.lit(1.0))


def months_between_ids(year: Column, month: Column) -> Column:
    """year * 100 + month, the panels' time id."""
    return year * 100 + month


def snake_case(name: str) -> str:
    """camelCase or dotted name to snake_case, at plan time."""
    import re

    return re.sub(r"[^0-9a-zA-Z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).lower().strip("_")


#: Patterns that mark party data: column names, and texts that hold an address or a phone number.
PARTY_COLUMN = r"(?i)(^|_)(buyer|seller|grantor|grantee|owner|contact)_?(name|phone|address|email|street)|(^|_)(e?mail|phone|grantee|grantor|street[0-9]?|mailing_zip|title_company|third_party)($|_)|^name$"
PARTY_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b"


def party_columns(df: DataFrame) -> list[str]:
    import re

    return [c for c in df.columns if re.search(PARTY_COLUMN, c)]


def holds_party_text(c: Column) -> Column:
    return c.rlike(PARTY_TEXT)
