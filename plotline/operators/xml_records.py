"""Records from XML members: recovery, parsing into typed records with child rows, validation, and a path audit."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from datetime import date
from decimal import Decimal, InvalidOperation

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The two root tags (the modern one first), and what wrappers of legacy child rows begin with.
ROOTS = ("ecrvForm", "us.mn.state.mdor.ecrv.extract.form.EcrvForm")
WRAPPER = "us.mn.state.mdor.ecrv.extract.form."

#: A record's fields after its key, date and price, by kind and section of the form: (name, tag).
_S, _P, _Q = "salesAgreementForm", "propertyForm", "supplementaryForm"
AMOUNTS = {"downpayment_equity": (_S, "downPmtEquity"), "seller_paid_points": (_S, "sellerPdPts"), "special_assessment_amount": (_S, "specialAssesmtAmt")}
TEXTS = {"finance_type": (_S, "financeType"), "deed_type": (_S, "deedTypeCde"), "property_county": (_P, "county"), "what_included": (_P, "whatIsIncludedInSale")}
FLAGS = {
    "principal_residence": (_P, "principalResidence"), "new_buildings_sale_year": (_P, "newBuildingsOnSaleYear"), "personal_property_included": (_S, "personalPropertyIncludedInTotal"),
    "related": (_Q, "relatedInd"), "gift": (_Q, "giftInd"), "government": (_Q, "governmentInd"), "legal_action": (_Q, "legalActionInd"), "name_change": (_Q, "nameChangeInd"),
    "non_market_price": (_Q, "nonMarketPriceInd"), "non_listed": (_Q, "nonListedInd"), "tax_exempt": (_Q, "taxExemptInd"),
    "buyer_part_interest": (_S, "buyerPartInterest"), "deed_payoff": (_S, "deedPayoff"), "agreement_2_yrs_old": (_S, "agreement2YrsOld"), "like_kind_exchange": (_S, "likeKindExchange"), "received_in_trade": (_S, "receivedInTrade"),
}
#: The child tables, where their rows are, and the columns of their exports.
CHILDREN = {
    "parcels": ([(_P, "parcels", None)], "id parcelId primary"),
    "addresses": ([(_P, "mnPropertyAddresses", None)], "id city street1 street2 zip"),
    "uses": ([(_P, "usesBeforeSale", "before"), (_P, "plannedUses", "planned")], "use_timing id tier1Cde tier2Cde tier3Cde primaryInd propertyTypeCode propertyUseCode"),
    "financing": ([(_S, "financeArrangements", None)], "id selected contractMortgageAmt interestRate interestRateType monthlyPaymentAmt numberPayments paymentFor paymentType paymentTypeOther balloonPaymentAmt balloonPaymentDate"),
    "personal_property": ([(_S, "personalProperties", None)], "id selected propertyDescription propertyValue"),
}
#: Answers that count as yes and no.
YES, NO = ("true", "1", "yes", "y"), ("false", "0", "no", "n")

KEY = ("source_key", "mn_county_code", "ecrv_id", "sale_date", "sale_year", "sale_month", "gross_sale_price")
TRANSACTION = (*KEY, *AMOUNTS, *TEXTS, *FLAGS)
_ROW = "array<map<string,string>>"
RECORD = {c: "integer" if c == "sale_year" else "boolean" if c in FLAGS else "string" for c in TRANSACTION} | {c: _ROW for c in CHILDREN} | {c: "string" for c in ("schema_variant", "encoding", "recovery_method", "issue_code")}

_REFERENCE = re.compile(r"&#(?:(\d+)|[xX]([0-9A-Fa-f]+));")
#: The first and last characters of the ranges that XML allows.
_LEGAL = ((0x9, 0xA), (0xD, 0xD), (0x20, 0xD7FF), (0xE000, 0xFFFD), (0x10000, 0x10FFFF))
_ILLEGAL = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LEGAL) + "]")
_DECLARATION = re.compile(r"\s*<\?xml[^?]*\?>")
_ENCODING = re.compile(r"encoding\s*=\s*['\"]([^'\"]+)", re.I)
_DTD = re.compile("<!(?:DOCTYPE|ENTITY)", re.I)
_COUNTY = re.compile(r"\d{2}")


class Rejected(ValueError):
    """Why a member gives no record; the message is the issue's code (fixed values, as are the schema variants' names)."""


def recover(raw: bytes, *, cp1252: bool = True, repair: bool = True) -> tuple[ET.Element, str, list[str]]:
    """(root, encoding, what was repaired). Bytes are UTF-8, else cp1252. A text that does not parse is parsed once more
    with U+FFFD for numeric references to characters that XML has not, and without such characters themselves."""
    how: list[str] = []
    encoding = "utf-8"
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        if not cp1252:
            raise Rejected("invalid_utf8") from None
        encoding = "cp1252"
        how.append(encoding)
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            raise Rejected("invalid_character_encoding") from None
    declaration = _DECLARATION.match(text)
    named = _ENCODING.search(declaration[0]) if declaration else None
    if named and named[1].lower() not in ("utf-8", "utf8"):
        raise Rejected("unsupported_declared_encoding")
    if "<!" in text and _DTD.search(text):
        raise Rejected("unsupported_dtd_or_entity")
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        fixed = _REFERENCE.sub(lambda m: "\ufffd" if _outside(int(m[1]) if m[1] else int(m[2], 16)) else m[0], text)
        clean = _ILLEGAL.sub("", fixed)
        if not repair or clean == text:
            raise Rejected("malformed_xml") from None
        how += ["invalid_numeric_reference"] * (fixed != text) + ["invalid_literal_character"] * (clean != fixed)
        try:
            root = ET.fromstring(clean)
        except ET.ParseError:
            raise Rejected("malformed_xml") from None
    if root.tag not in ROOTS:
        raise Rejected("unsupported_root")
    return root, encoding, how


def _outside(n: int) -> bool:
    return n > 0x10FFFF or bool(_ILLEGAL.match(chr(n)))


def _amount(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        number = Decimal(text)
    except InvalidOperation:
        number = Decimal("nan")
    if not number.is_finite():
        raise Rejected("invalid_amount")
    return str(number)


_KEYS = {"county": ("headerForm", "countyCde"), "number": ("headerForm", "crvNumberId"), "date": (_S, "deedContractDate"), "price": (_S, "totPurchaseAmt")}
#: What a record reads of each section: fields by their tags, and where child rows go, in the order of their tables.
_FIELDS: dict[str, dict[str, str]] = {}
for _name, (_section, _at) in (_KEYS | AMOUNTS | TEXTS | FLAGS).items():
    _FIELDS.setdefault(_section, {})[_at] = _name
_PLACES = [(name, *place) for name, (places, _) in CHILDREN.items() for place in places]
_ROWS: dict[str, dict[str, int]] = {}
for _i, (_, _section, _at, _) in enumerate(_PLACES):
    _ROWS.setdefault(_section, {})[_at] = _i
_ANSWERS = dict.fromkeys(YES, True) | dict.fromkeys(NO, False)
_ABSENT = dict.fromkeys((*AMOUNTS, *TEXTS, *FLAGS))
_CODED = (f"{WRAPPER}PlannedUseForm", "propertyTypeCode")


def _child_row(holder: ET.Element, timing: str | None) -> dict[str, str | None]:
    """A row of (tag, text) of an element; a lone wrapper inside it is looked through."""
    if len(holder) == 1 and holder[0].tag.startswith(WRAPPER):
        holder = holder[0]
    row: dict[str, str | None] = {} if timing is None else {"use_timing": timing}
    for p in holder:
        tag, text = p.tag, p.text
        if not tag.startswith(WRAPPER):
            row[tag] = text.strip() or None if text else None
    return row


def record_of(root: ET.Element) -> dict:
    """The record below a root: its transaction fields, child rows and schema variant. Raises the first rule it breaks: key,
    county of the property, date, price, other amounts."""
    first: dict[str, str | None] = {}  # the first text of each field
    held: list[list[ET.Element]] = [[] for _ in _PLACES]
    for section in root:
        fields, rows = _FIELDS.get(section.tag, {}), _ROWS.get(section.tag, {})
        for field in section:
            tag = field.tag
            if tag in rows:
                held[rows[tag]].append(field)
            elif tag in fields:
                first.setdefault(fields[tag], field.text)
    # an element without text is absent, one of blanks is an empty text
    first = {name: text.strip() for name, text in first.items() if text}
    county, number = first.pop("county", None), first.pop("number", None)
    if not (county and number and _COUNTY.fullmatch(county) and 1 <= int(county) <= 87 and number.isdigit()):
        raise Rejected("invalid_transaction_key")
    if first.get("property_county", "") not in ("", county):
        raise Rejected("county_mismatch")
    try:
        day = date.fromisoformat(first.pop("date", "")[:10]).isoformat()
    except ValueError:
        raise Rejected("invalid_sale_date") from None
    price = _amount(first.pop("price", None))
    if price is None:
        raise Rejected("missing_required_amount")
    if Decimal(price) <= 0:
        raise Rejected("nonpositive_sale_price")
    out = dict(zip(KEY, (f"MN:ecrv:{county}:{number}", county, number, day, int(day[:4]), day[:7], price))) | _ABSENT
    for name, text in first.items():
        out[name] = _ANSWERS.get(text.lower()) if name in FLAGS else _amount(text) if name in AMOUNTS else text
    out |= {name: [] for name in CHILDREN}
    for (name, _, _, timing), holders in zip(_PLACES, held):
        if holders:
            out[name] += [_child_row(h, timing) for h in holders]
    if root.tag == ROOTS[0]:
        out["schema_variant"] = "schema3_flat_2020_11_plus"
    elif any(w.tag == _CODED[0] and w.find(_CODED[1]) is not None for h in held[_ROWS[_P]["usesBeforeSale"]] for w in h):
        out["schema_variant"] = "legacy_2015_property_codes"
    else:
        out["schema_variant"] = "legacy_tiered_with_deed_type_2019_08_to_2020_11" if out["deed_type"] else "legacy_tiered_2016_to_2019_08"
    return out


def parse_record(raw: bytes, *, cp1252: bool = True, repair: bool = True) -> dict:
    """The record of a member's bytes. A rejected one has its issue's code and what was repaired, and no fields."""
    out: dict = {"issue_code": ""}
    try:
        root, out["encoding"], how = recover(raw, cp1252=cp1252, repair=repair)
        out["recovery_method"] = "+".join(how) or None
        return out | record_of(root)
    except Rejected as e:
        return out | {"issue_code": str(e)}


_ARROW = {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_()}
_MAP = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def _rows_array(lists: list[list[dict] | None]) -> pa.Array:
    """Child rows as an Arrow list of maps, from flat lists of their tags and texts."""
    starts, at, keys, values = [0], [0], [], []
    for rows in lists:
        for row in rows or ():
            keys += row
            values += row.values()
            at.append(len(keys))
        starts.append(len(at) - 1)
    maps = pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), maps, mask=pa.array([rows is None for rows in lists], pa.bool_()))


_JSON = json.JSONEncoder(sort_keys=True)


def _digest(rows: list[dict] | None) -> bytes | None:
    """128 bits of child rows, the tags of each in order; None for no rows."""
    return hashlib.blake2b(_JSON.encode(rows).encode(), digest_size=16).digest() if rows else None


def parse_members(members: DataFrame, content: str = "content", *, cp1252: bool = True, repair: bool = True, fields: Sequence[str] | None = None) -> DataFrame:
    """``members`` with the record of each binary ``content`` in its place: the transaction's fields, an array of rows (maps
    of tag and text) for each child table, schema variant, encoding, what was repaired and whether anything was, issue code
    (empty if valid; a rejected member has no fields), SHA-256 of the bytes, and of the record's whole content.

    XML recovery has no built-in form, so it runs in Arrow batches; hashes are expressions, computed where they are read.
    A null content is an empty one (malformed). With ``fields`` (names of RECORD, or ``<child>_digest`` for 128 bits of
    a child table's rows, null if it has none) these alone are made, and no hashes: what leaves Python is never pruned by
    the optimizer."""
    raw = members if fields is not None else members.withColumn("raw_sha256", F.sha2(F.coalesce(content, F.lit(b"")), 256))
    given = [c for c in raw.columns if c != content]
    digests = {f"{c}_digest": c for c in CHILDREN}
    made = {name: RECORD.get(name, "binary") for name in (RECORD if fields is None else fields)}
    unknown = [name for name in made if name not in RECORD and name not in digests]
    if unknown:
        raise ValueError(f"no fields of a record: {', '.join(unknown)}")

    def column(name: str, records: list[dict]) -> pa.Array:
        if name in digests:
            return pa.array([_digest(r.get(digests[name])) for r in records], pa.binary())
        values = [r.get(name) for r in records]
        return _rows_array(values) if made[name] == _ROW else pa.array(values, _ARROW[made[name]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                records = [parse_record(raw or b"", cp1252=cp1252, repair=repair) for raw in part.column(content).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in given], *[column(name, records) for name in made]], names=[*given, *made])

    schema = T.StructType([raw.schema[c] for c in given])
    for name, kind in made.items():
        schema = schema.add(name, _MAP if kind == _ROW else kind)
    out = raw.mapInArrow(run, schema)
    if fields is not None:
        return out
    return out.withColumns({"parse_recovered": F.col("recovery_method").isNotNull(), "analytical_hash": content_hash()})


def row_text(row: Column) -> Column:
    """A child row as one text, its tags in order."""
    return F.to_json(F.array_sort(F.map_entries(row)))


def content_hash() -> Column:
    """SHA-256 over every transaction field and every child row of a record; null for a rejected one."""
    children = [F.transform(c, row_text).alias(c) for c in CHILDREN]
    return F.when(F.col("source_key").isNotNull(), F.sha2(F.to_json(F.struct(*TRANSACTION, *children)), 256))


def with_counties(records: DataFrame, counties: DataFrame) -> DataFrame:
    """``records`` with county_name, county_fips and is_twin_cities from (code, name, fips) rows, one for each county of the
    metropolitan area; a code that occurs twice there would repeat records, so it raises. Records are not dealt by county
    (few keys) for it: the counties, two digits each, go to all of them."""
    from plotline.operators.joins import assert_unique

    c = assert_unique(counties, ["code"], "counties").select(F.col("code").alias("mn_county_code"), F.col("name").alias("county_name"), F.col("fips").alias("county_fips"), F.lit(True).alias("is_twin_cities"))
    return records.join(F.broadcast(c), "mn_county_code", "left").withColumn("is_twin_cities", F.coalesce("is_twin_cities", F.lit(False)))


def child_table(records: DataFrame, child: str, keys: Sequence[str] = ("source_key",)) -> DataFrame:
    """(keys, ordinal, the child table's columns): a row for each child row of the valid records, ordinals from 1."""
    _, names = CHILDREN[child]
    rows = records.where(F.col("source_key").isNotNull()).select(*keys, F.posexplode(child).alias("_at", "_row"))
    return rows.select(*keys, (F.col("_at") + 1).alias("ordinal"), *[F.col("_row")[n].alias(n) for n in names.split()])


def child_rows(records: DataFrame, keys: Sequence[str] = ("source_key",)) -> DataFrame:
    """(keys, child, ordinal, row as text) of all child tables of the valid records."""
    every = F.array(*[F.struct(F.lit(c).alias("child"), F.transform(c, row_text).alias("rows")) for c in CHILDREN])
    sets = records.where(F.col("source_key").isNotNull()).select(*keys, F.explode(every).alias("_s"))
    return sets.select(*keys, F.col("_s.child").alias("child"), F.posexplode("_s.rows").alias("_at", "row")).select(*keys, "child", (F.col("_at") + 1).alias("ordinal"), "row")


def audit_paths(members: DataFrame, group: str, content: str = "content") -> DataFrame:
    """(group, path, present, nonempty): in how many members of a group each element path occurs, and with text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, raw in zip(b[group], b[content]):
                try:
                    root = recover(bytes(raw or b""))[0]
                except Rejected:
                    continue
                seen: dict[str, bool] = {}
                todo = [(root, root.tag)]
                while todo:
                    node, path = todo.pop()
                    seen[path] = seen.get(path, False) or bool((node.text or "").strip())
                    todo += [(c, f"{path}/{c.tag}") for c in node]
                rows += [(g, p, full) for p, full in seen.items()]
            yield pd.DataFrame(rows, columns=[group, "path", "full"])

    kind = dict(members.dtypes)[group]
    found = members.select(group, content).mapInPandas(run, f"`{group}` {kind}, path string, full boolean")
    return found.groupBy(group, "path").agg(F.count(F.lit(1)).alias("present"), F.count_if("full").alias("nonempty"))


def member_dispositions(members: DataFrame, max_bytes: int = 10 << 20) -> DataFrame:
    """Issue of each parsed member (archive, ordinal, name, bytes and `parse_members`' columns), first rule that fits:
    duplicate_member_name, non_xml_member, oversize_member, the parse error, filename_key_mismatch (a name that ends in
    NN_digits.xml must name the record's county and number), duplicate_source_key among valid members (the first wins),
    valid."""
    named = F.row_number().over(Window.partitionBy("archive", "name").orderBy("ordinal"))
    told = r"(?i)([0-9]{2})_([0-9]+)\.xml$"
    other = F.col("name").rlike(told) & ((F.regexp_extract("name", told, 1) != F.col("mn_county_code")) | (F.regexp_extract("name", told, 2) != F.col("ecrv_id")))
    issue = (
        F.when(named > 1, "duplicate_member_name").when(~F.lower("name").endswith(".xml"), "non_xml_member").when(F.col("bytes") > max_bytes, "oversize_member")
        .when(F.col("issue_code") != "", F.col("issue_code")).when(other, "filename_key_mismatch").otherwise("")
    )
    m = members.withColumn("disposition", issue)
    # rejected members have no key: they are told apart by their place, so that they don't meet in one window
    apart = F.when(F.col("disposition") != "", F.col("ordinal"))
    nth = F.row_number().over(Window.partitionBy("archive", "source_key", apart).orderBy("ordinal"))
    return m.withColumn("disposition", F.when(F.col("disposition") != "", F.col("disposition")).when(nth > 1, "duplicate_source_key").otherwise("valid"))


def batch_status(disposed: DataFrame, by: str = "archive") -> DataFrame:
    """Per archive: members, valid and recovered ones, errors, and its status, ``complete`` without any error. A batch is
    registered with its status in one commit (`sinks.commit_batch`), so that an archive being read has none."""
    ok = F.col("disposition") == "valid"
    g = disposed.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.count_if(ok).alias("valid"), F.count_if(ok & F.col("parse_recovered")).alias("recovered"), F.count_if(~ok).alias("errors"))
    return g.withColumn("status", F.when(F.col("errors") == 0, "complete").otherwise("incomplete"))


def member_events(disposed: DataFrame) -> DataFrame:
    """(archive, ordinal, name, issue_code, severity): an error for each member that is not valid, a warning for each
    valid one that had to be repaired."""
    code = F.when(F.col("disposition") != "valid", F.col("disposition")).when(F.col("parse_recovered"), "parse_recovered")
    kind = F.when(F.col("disposition") == "valid", "warning").otherwise("error")
    return disposed.select("archive", "ordinal", "name", code.alias("issue_code"), kind.alias("severity")).where("issue_code is not null")
