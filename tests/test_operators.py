"""Small hand-made cases of the library's operators."""

import io
import json
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plotline.functions import expr as X
from plotline.operators import contract as C
from plotline.operators import dedup as D
from plotline.operators import joins as J
from plotline.operators import panel as P
from plotline.operators import stats as S
from plotline.operators import versions as V
from plotline.operators import windows as W
from plotline.operators import xml_records as XML
from plotline.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,zeros,want", [("46202-0001", False, "46202"), ("602.0", False, "00602"), ("00000", False, None), ("bad", False, None), (None, False, None), ("46202.000", True, "46202"), ("46202.", True, "46202"), ("46202.000", False, None)])
def test_zip5(spark, raw, zeros, want):
    assert one(spark, X.zip5(F.lit(raw).cast("string"), zeros)) == want


def test_flags_dates_keys(spark):
    assert [one(spark, X.flag(F.lit(v).cast("string"))) for v in (" y ", "No", "1", "maybe", None)] == [True, False, True, None, None]
    assert [str(one(spark, X.mixed_date(F.lit(v)))) for v in ("03/17/2015", "2015-03-17", "bad")] == ["2015-03-17", "2015-03-17", "None"]
    assert one(spark, X.source_key(F.lit("not a valid id"), "IN:SDF:")) is None
    assert one(spark, X.number(F.lit("25000000"), 100)) == 250000.0


def test_reasons_policy(spark):
    rules = [("a", F.lit(None).cast("boolean")), ("b", F.lit(True)), ("c", F.lit(False))]
    assert one(spark, X.reasons(rules, True)) == "a;b" and one(spark, X.reasons(rules, False)) == "b"


def test_bounds_are_exclusive_below_inclusive_above(spark):
    assert [one(spark, X.in_bounds(F.lit(float(p)))) for p in (50_000, 50_000.01, 15_000_000, 15_000_001)] == [False, True, True, False]


def test_unique_check(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        J.join_n1(df, df, ["k"])


def rows(spark):
    data = [(None, 1, "s", 1), ("u", 1, "s", 2), ("e", 1, "s", 3), ("e", 1, "s", 4), ("v", 1, "s", 5), ("v", 1, None, 6), ("c", 1, "s", 7), ("c", 2, "s", 8)]
    return spark.createDataFrame(data, "key string, core int, st string, n int")


def test_dispositions_partition_rows(spark):
    d = D.dispositions(rows(spark), key="key", core=["core"], status=["st"], prefer=[F.desc("n")])
    got = {r.n: (r.disposition, r.kept, r.st) for r in d.collect()}
    assert got[1] == ("invalid_key", False, "s") and got[2] == ("unique", True, "s")
    assert not got[3][1] and got[4] == ("exact", True, "s")
    assert got[6] == ("status_variant", True, None) and not got[5][1]
    assert got[7][:2] == got[8][:2] == ("conflict", False)
    f = D.funnel(d.withColumn("y", F.lit(1)), ["y"]).first()
    assert f.balanced and (f.raw, f.invalid, f.exact, f.variant, f.conflicting, f.kept) == (8, 1, 1, 1, 2, 3)


def test_index_gap_and_real_price(spark):
    s = spark.createDataFrame([("2024-01-01", 100.0), ("2025-01-01", 120.0), ("2025-02-01", 140.0)], "d string, cpi double").select(F.to_date("d").alias("d"), "cpi")
    gap = P.monthly_index(spark.createDataFrame([("2025-01-01", 100.0), ("2025-03-01", 104.0)], "d string, cpi double").select(F.to_date("d").alias("d"), "cpi"), "d", "cpi").orderBy("month_start").collect()
    assert [(r.cpi, r.imputed) for r in gap] == [(100.0, False), (102.0, True), (104.0, False)]
    index = s.withColumnRenamed("d", "month_start")
    sales = spark.createDataFrame([("2024-01-01", 100000.0), ("2025-01-01", 120000.0)], "m string, price double").select(F.to_date("m").alias("m"), "price")
    got = P.real_price(sales, index, price="price", month="m", value="cpi", base_year=2025).orderBy("m").collect()
    assert [round(r.real_price, 6) for r in got] == [130000.0, 130000.0] and got[0].price == 100000.0
    with pytest.raises(ValueError):
        P.monthly_index(spark.createDataFrame([("2025-01-01", None), ("2025-02-01", 1.0)], "d string, cpi double").select(F.to_date("d").alias("d"), "cpi"), "d", "cpi")


def test_tier_breaks_separate_clusters(spark):
    rng = np.random.default_rng(1)
    prices = np.concatenate([np.exp(rng.normal(m, 0.05, 300)) for m in (11, 12.5, 14)])
    b = P.tier_breaks(spark.createDataFrame([(float(p),) for p in prices], "p double"), "p")
    assert abs(np.log(b[0]) - 11.75) < 0.05 and abs(np.log(b[1]) - 13.25) < 0.05
    got = [one(spark, P.tier(F.lit(float(x)), [10, 20], ["a", "b", "c"])) for x in (10, 10.5, 20, 21)]
    assert got == ["a", "b", "b", "c"]


def test_panel_fills_counts_only(spark):
    axis, months = spark.createDataFrame([("x",), ("y",)], "c string"), spark.createDataFrame([(1,), (2,)], "m int")
    p = P.balanced_panel(spark.createDataFrame([("x", 1, 3, 9.0)], "c string, m int, n long, price double"), [axis, months], ["c", "m"], ["n"]).collect()
    assert len(p) == 4 and sorted(r.n for r in p) == [0, 0, 0, 3] and sum(r.price is None for r in p) == 3


def test_latest_wins_whatever_the_arrival(spark):
    obs = [("k1", "2024-01-01", "a", 1), ("k1", "2024-02-01", "b", 2), ("k2", "2024-01-01", "a", 3), ("k2", "2024-01-01", "c", 4)]
    for data in (obs, obs[::-1]):
        v = V.current_view(spark.createDataFrame(data, "k string, x string, h string, o int"), key="k", extract="x", content="h", order=[F.desc("x"), F.desc("o")])
        got = {r.k: (r.h, r.first_extract, r.revision_conflict) for r in v.collect()}
        assert got == {"k1": ("b", "2024-01-01", False), "k2": ("c", "2024-01-01", True)}


def test_gaps(spark):
    days = spark.createDataFrame([("2024-01-08",), ("2024-01-15",), ("2024-01-24",), ("2024-02-05",)], "d string").select(F.to_date("d").alias("d"))
    assert [r.gap_class for r in W.classify_gaps(days, "d").orderBy("d").collect()] == ["first", "normal", "delayed", "probable_missing"]


def test_adjusted_price_and_lag(spark):
    f = lambda inc, pp, ok: one(spark, C.adjusted_price(F.lit(300000.0), F.lit(1000.0), F.lit(inc), F.lit(pp), F.lit(ok)))
    assert f(True, 5000.0, True) == 294000.0 and f(False, 0.0, True) == 299000.0 and f(True, 5000.0, False) is None
    d = spark.createDataFrame([("a", "2024-01-01", "2024-01-05")], "k string, s string, x string").select("k", F.to_date("s").alias("s"), F.to_date("x").alias("x"))
    r = C.reporting(d, key="k", sale_date="s", first_extract="x").first()
    assert (r.lag_days, r.maturity_days, r.recent) == (4, 4, False)


def record(note="ok", county="27", amount="300000.0000", date="2024-01-02T00:00:00-06:00", root="ecrvForm"):
    return f"<{root}><headerForm><countyCde>{county}</countyCde><crvNumberId>123</crvNumberId></headerForm><propertyForm><parcels><id>1</id></parcels><parcels/></propertyForm><salesAgreementForm><deedContractDate>{date}</deedContractDate><totPurchaseAmt>{amount}</totPurchaseAmt></salesAgreementForm><n>{note}</n></{root}>".encode()


def test_xml_recovery():
    r = XML.parse_record(record())
    assert r["source_key"] == "MN:ecrv:27:123" and r["issue_code"] == "" and r["parcels"] == [{"id": "1"}, {}] and r["sale_date"] == "2024-01-02" and r["sale_month"] == "2024-01"
    method = lambda raw: XML.parse_record(raw)["recovery_method"]
    assert method(record("&#11;").replace(b"ok", b"")) == "invalid_numeric_reference"
    assert method(record().replace(b"ok", b"\x93x\x94&#11;")) == "cp1252+invalid_numeric_reference"
    assert method(record().replace(b"ok", b"\x0b")) == "invalid_literal_character"
    assert method(record().replace(b"ok", b"\x0b&#xFFFFFFFF;")) == "invalid_numeric_reference+invalid_literal_character"
    code = lambda raw, **how: XML.parse_record(raw, **how)["issue_code"]
    assert code(record().replace(b"ok", b"\x81\xff")) == "invalid_character_encoding"
    assert code(record().replace(b"ok", b"\x93"), cp1252=False) == "invalid_utf8"
    assert code(record("&#11;"), repair=False) == code(record("a & b")) == code(b"") == code(b" <?xml version='1.0'?>" + record()) == "malformed_xml"
    assert code(b"\xef\xbb\xbf<?xml version='1.0' encoding='utf8'?>" + record()) == ""
    assert code(b'<?xml version="1.0" encoding="windows-1252"?>' + record()) == "unsupported_declared_encoding"
    assert code(b"<!DOCTYPE x><ecrvForm/>") == code(b"<!doctype x><ecrvForm/>") == "unsupported_dtd_or_entity"
    assert code(record(root="other")) == "unsupported_root" and code(record(root=XML.ROOTS[1])) == ""


def test_xml_rules():
    code = lambda **change: XML.parse_record(record(**change))["issue_code"]
    assert [code(county=c) for c in ("99", "0", "7", "00", "007", "a7")] == ["invalid_transaction_key"] * 6
    assert [code(date=d) for d in ("2024-02-31", "2024-2-3", "", "x")] == ["invalid_sale_date"] * 4 and code(date="2024-02-29") == ""
    assert code(amount="") == "missing_required_amount"
    assert [code(amount=a) for a in (" ", "x", "NaN", "Infinity", "1,000")] == ["invalid_amount"] * 5
    assert [code(amount=a) for a in ("0", "-1", "-.5")] == ["nonpositive_sale_price"] * 3
    assert [XML.parse_record(record(amount=a))["gross_sale_price"] for a in (".5", "1e5", " 300000.0000 ")] == ["0.5", "1E+5", "300000.0000"]
    body = lambda more: XML.parse_record(record().replace(b"<propertyForm>", b"<propertyForm>" + more))
    assert body(b"<county>7</county>")["issue_code"] == "county_mismatch" and body(b"<county> </county>")["issue_code"] == body(b"<county/>")["issue_code"] == ""
    assert body(b"<county>28</county><county>27</county>")["issue_code"] == "county_mismatch"  # the first of several counts
    sales = lambda more: XML.parse_record(record().replace(b"<salesAgreementForm>", b"<salesAgreementForm>" + more))
    assert sales(b"<sellerPdPts>x</sellerPdPts>")["issue_code"] == "invalid_amount" and sales(b"<sellerPdPts>1.50</sellerPdPts>")["seller_paid_points"] == "1.50"
    flags = sales(b"<deedPayoff>Yes</deedPayoff><likeKindExchange>0</likeKindExchange><agreement2YrsOld>?</agreement2YrsOld>")
    assert (flags["deed_payoff"], flags["like_kind_exchange"], flags["agreement_2_yrs_old"], flags["gift"]) == (True, False, None, None)
    assert body(b"<whatIsIncludedInSale>a&#11;b</whatIsIncludedInSale>")["what_included"] == "a\ufffdb"
    assert not set(XML.parse_record(record(county="99"))) & set(XML.TRANSACTION)


def test_xml_children_and_variants(spark):
    wrap = lambda inner: f"<usesBeforeSale><{XML.WRAPPER}PlannedUseForm>{inner}</{XML.WRAPPER}PlannedUseForm></usesBeforeSale>".encode()
    legacy = record(root=XML.ROOTS[1])
    at = lambda raw, where, more: raw.replace(where, where + more)
    uses = at(legacy, b"<propertyForm>", wrap("<tier1Cde>RESID</tier1Cde><tier2Cde> SINGLEFAM </tier2Cde>") + b"<plannedUses><id>9</id><id>8</id></plannedUses>")
    r = XML.parse_record(uses)
    assert r["uses"] == [{"use_timing": "before", "tier1Cde": "RESID", "tier2Cde": "SINGLEFAM"}, {"use_timing": "planned", "id": "8"}]
    variants = [r, XML.parse_record(record()), XML.parse_record(at(legacy, b"<propertyForm>", wrap("<propertyTypeCode>RES</propertyTypeCode>"))), XML.parse_record(at(legacy, b"<salesAgreementForm>", b"<deedTypeCde>WARRANTY</deedTypeCde>"))]
    assert [v["schema_variant"] for v in variants] == ["legacy_tiered_2016_to_2019_08", "schema3_flat_2020_11_plus", "legacy_2015_property_codes", "legacy_tiered_with_deed_type_2019_08_to_2020_11"]
    changed = [uses, uses.replace(b"RESID", b"COMM"), at(uses, b"<salesAgreementForm>", b"<deedTypeCde>X</deedTypeCde>"), uses.replace(b">ok<", b">other<"), None, record(county="0")]
    rows = XML.parse_members(spark.createDataFrame([(i, c) for i, c in enumerate(changed)], "ordinal int, content binary"))
    hashes = {x.ordinal: x.analytical_hash for x in rows.select("ordinal", "analytical_hash").collect()}
    assert len({hashes[i] for i in range(3)}) == 3 and hashes[0] == hashes[3] and hashes[4] is hashes[5] is None
    table = XML.child_table(rows.withColumnRenamed("ordinal", "member"), "uses", ["member"])
    assert [tuple(x)[:5] for x in table.where("member = 0").orderBy("ordinal").collect()] == [(0, 1, "before", None, "RESID"), (0, 2, "planned", "8", None)]
    kinds = XML.child_rows(rows.withColumnRenamed("ordinal", "member"), ["member"]).where("member = 1").groupBy("child").count().collect()
    assert {x.child: x["count"] for x in kinds} == {"uses": 2, "parcels": 2}
    counties = spark.createDataFrame([("27", "Hennepin", "27053")], "code string, name string, fips string")
    named = XML.with_counties(rows, counties).where("source_key is not null").select("county_name", "county_fips", "is_twin_cities").distinct().collect()
    assert [tuple(x) for x in named] == [("Hennepin", "27053", True)]
    with pytest.raises(ValueError):
        XML.with_counties(rows, counties.union(counties))
    assert XML.parse_members(spark.createDataFrame([], "ordinal int, content binary")).count() == 0


def test_asked_fields_alone_leave_python(spark):
    use = b"<plannedUses><id>9</id><tier1Cde>RESID</tier1Cde></plannedUses>"
    at = lambda more: record().replace(b"<propertyForm>", b"<propertyForm>" + more)
    turned, other = at(b"<plannedUses><tier1Cde>RESID</tier1Cde><id>9</id></plannedUses>"), at(use.replace(b"9", b"8"))
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([at(use), turned, other, record(), record(county="0")])], "ordinal int, content binary")
    told = XML.parse_members(rows, fields=["source_key", "uses_digest"])
    assert told.columns == ["ordinal", "source_key", "uses_digest"]
    d = [r.uses_digest for r in told.orderBy("ordinal").collect()]
    assert d[0] == d[1] != d[2] and len(d[2]) == 16 and d[3] is d[4] is None
    with pytest.raises(ValueError, match="colour"):
        XML.parse_members(rows, fields=["colour"])


def test_revisions_parse_each_extract_once(spark):
    from plotline.plans import QUERIES

    plan = QUERIES["record_revisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_contract_of_records_is_that_of_their_tables(spark):
    goods = lambda *rows: b"".join(b"<personalProperties><selected>%s</selected><propertyValue>%s</propertyValue></personalProperties>" % r for r in rows)
    use = lambda tag, a, b: b"<%s><tier1Cde>%s</tier1Cde><tier2Cde>%s</tier2Cde></%s>" % (tag, a, b, tag)
    yes, sf, old, new = b"<personalPropertyIncludedInTotal>true</personalPropertyIncludedInTotal>", b"SINGLEFAM", b"usesBeforeSale", b"plannedUses"
    made = [
        (b"", b""), (use(old, b"RESID", sf) + use(new, b"COMM", sf), yes + goods((b"yes", b"1.25"), (b"true", b"2"), (b"no", b"x"))), (use(old, b"RESID", sf) + use(old, b"COMM", sf), yes + goods((b"1", b"x"), (b"1", b"3"))),
        (use(new, b"RESID", sf), yes + goods((b"1", b"-1"))), (b"<usesBeforeSale/>", yes + goods((b"0", b"5"))), (use(old, b"RESID", sf) * 2, yes + goods((b"1", b""), (b"?", b"7"))),
        (b"<parcels><parcelId>7</parcelId></parcels>" * 2, b"<sellerPdPts>5</sellerPdPts>" + goods((b"1", b"9"))),
    ]
    content = [record().replace(b">123<", b">%d<" % i).replace(b"<propertyForm>", b"<propertyForm>" + p).replace(b"<salesAgreementForm>", b"<salesAgreementForm>" + g) for i, (p, g) in enumerate(made, 1)]
    content.append(record(date="2031-01-01"))  # not of these years
    counties = spark.createDataFrame([("27", "Hennepin", "27053")], "code string, name string, fips string")
    members = lambda c: spark.createDataFrame([(i, f"2024-0{1 + i % 3}", x) for i, x in enumerate(c)], "ordinal int, archive string, content binary")
    day = F.concat("archive", F.lit("-28"))
    more = {"revision_conflict": F.lit(False), "archive_name": F.col("archive"), "extract_timestamp": day, "first_extract_timestamp": day, "version_id": F.col("raw_sha256")}
    sales = lambda c: XML.with_counties(XML.parse_members(members(c)).where("issue_code = ''"), counties).withColumns(more)
    how = {"first": 2024, "last": 2024, "counties": ["Hennepin"], "urban": ["Hennepin"]}
    s = sales(content)
    a = C.prepare_second_state(s, *[XML.child_table(s, c) for c in ("uses", "parcels", "personal_property")], **how)
    b = C.prepare_second_records(s, **how)
    rows = lambda d: sorted(map(str, d.collect()))
    assert a.dtypes == b.dtypes and rows(a) == rows(b) and b.count() == len(made)
    # what is returned was parsed once, before
    few = C.prepare_second_records(s, columns=["parcel_count", "source_key", "recent_reporting_period"], **how)
    assert few.columns == ["parcel_count", "source_key", "recent_reporting_period"] and rows(few) == rows(a.select(few.columns))
    assert "MapInArrow" not in few._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="not unique"):
        C.prepare_second_records(sales([content[0], content[0]]), **how)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x_2024-01-08-03-00-00.zip", "w") as z:
        for name, body in (("27_123.xml", record()), ("27_124.xml", record()), ("note.txt", b"x"), ("a.xml", record("a & b"))):
            z.writestr(name, body)
    archives = readers.read_archives(spark, str(tmp_path), year=2024)
    assert archives.first()["extract_timestamp"].year == 2024
    m = XML.member_dispositions(XML.parse_members(readers.read_members(archives)))
    assert {r.name: r.disposition for r in m.collect()} == {"27_123.xml": "valid", "27_124.xml": "filename_key_mismatch", "note.txt": "non_xml_member", "a.xml": "malformed_xml"}
    paths = {r.path: (r.present, r.nonempty) for r in XML.audit_paths(readers.read_members(archives), "archive").collect()}
    assert paths["ecrvForm/headerForm/countyCde"] == (2, 2) or paths["ecrvForm/headerForm/countyCde"] == (3, 3)
    assert readers.read_archives(spark, str(tmp_path), year=2020).count() == 0
    with zipfile.ZipFile(tmp_path / "x_2023-01-08-03-00-00.zip", "w") as z:
        z.writestr("27_125.xml", record())
    names = lambda **how: [r.archive[2:6] for r in readers.read_archives(spark, str(tmp_path), **how).collect()]
    assert sorted(names()) == ["2023", "2024"] and names(limit=1) == ["2023"] and names(archive="x_2024-01-08-03-00-00.zip") == ["2024"]
    status = {r.archive[2:6]: (r.members, r.valid, r.errors, r.status) for r in XML.batch_status(m).collect()}
    assert status == {"2024": (4, 1, 3, "incomplete")}
    assert Counter(r.issue_code for r in XML.member_events(m).collect()) == Counter(["filename_key_mismatch", "non_xml_member", "malformed_xml"])

def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members:
            z.writestr(name, body)


def test_members_are_read_by_ranges(spark, tmp_path, monkeypatch):
    from plotline.sources import archives as AR

    body = lambda n: record(note="x" * 500).replace(b">123<", f">{n}<".encode())
    archive(tmp_path / "a_2024-01-08-03-00-00.zip", [(f"27_{i}.xml", body(i)) for i in range(1, 301)] + [("dir/", b""), ("big.xml", b"y" * 5000)])
    paths = [str(tmp_path / "a_2024-01-08-03-00-00.zip")]
    m = AR.scan_members(spark, paths, range_bytes=20_000)
    assert m.rdd.getNumPartitions() > 5
    rows = m.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, 302)) and bytes(rows[6].content) == body(7) and rows[6].name == "27_7.xml" and rows[0].archive == "a_2024-01-08-03-00-00.zip"
    assert XML.parse_members(m).where("issue_code = ''").count() == 300
    assert AR.scan_members(spark, []).count() == 0
    reader = lambda: AR.MemberReader({"paths": json.dumps(paths)})
    monkeypatch.setattr(readers, "MAX_MEMBERS", 100)
    with pytest.raises(ValueError, match="limits"):
        reader().partitions()
    monkeypatch.undo()
    monkeypatch.setattr(readers, "MAX_ARCHIVE", 1000)
    with pytest.raises(ValueError, match="limits"):
        reader().partitions()


def test_ingest_skips_what_is_registered(spark, tmp_path):
    from plotline.sources import archives as AR

    zips, root, check = tmp_path / "zips", str(tmp_path / "store"), str(tmp_path / "check")
    zips.mkdir()
    old, new = record(amount="300000"), record(amount="310000")
    archive(zips / "w_2024-01-08-07-00-00.zip", [("27_123.xml", old), ("note.txt", b"x")])
    run = lambda parser="1.0": AR.ingest_archives(spark, str(zips), root, parser=parser, checkpoint=check)
    table = lambda name: sinks.committed(spark, root, name)
    run()
    assert table("observations").count() == table("versions").count() == 1 and {r.issue_code for r in table("events").collect()} == {"non_xml_member"}
    run()  # nothing new
    archive(zips / "w_2024-02-05-07-00-00.zip", [("27_123.xml", new)])
    (zips / "copy.zip").write_bytes((zips / "w_2024-01-08-07-00-00.zip").read_bytes())  # the first one under another name
    run()
    registry = spark.read.parquet(f"{root}/registry").orderBy("extract_timestamp").collect()
    assert [(r.status, r.members, r.valid, r.errors, r.parser_version) for r in registry] == [("incomplete", 2, 1, 1, "1.0"), ("complete", 1, 1, 0, "1.0")]
    assert table("observations").count() == table("versions").count() == 2
    # the latest extract wins, versions remain
    seen = table("observations").join(spark.read.parquet(f"{root}/registry").select("archive_sha256", "extract_timestamp"), "archive_sha256").join(table("versions").select("version_id", "gross_sale_price"), "version_id")
    assert W.latest(seen, ["source_key"], [F.desc("extract_timestamp")]).first().gross_sale_price == "310000"
    # a batch that broke off before its registry row is not seen, and is read again
    batch = spark.read.format("binaryFile").load(str(zips / "w_2024-02-05-07-00-00.zip")).select("path", "length", F.sha2("content", 256).alias("archive_sha256"))
    assert AR.store_archives(batch, "1.0-9", root, "1.0") == 0
    sinks.write_parquet(table("observations").drop("batch_id"), f"{root}/observations/batch_id=2.0-0")
    assert table("observations").count() == 2
    run("2.0")  # another parser reads all archives once more
    assert table("observations").count() == table("versions").count() == 4 and spark.read.parquet(f"{root}/registry").count() == 4

def test_pages_are_fetched_by_tasks_with_retries(spark):
    import http.server
    import threading

    from plotline.sources import paged

    asked = Counter()

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            year = self.path.rsplit("=", 1)[-1]
            code = 404 if year == "gone" else 503 if year == "2021" and asked[self.path] < 3 else 200
            body = b"" if year == "none" else json.dumps([["NAME", "B19013_001E", "state", "zip code tabulation area"], [f"ZCTA {year}", "52000", None, "46202"], ["x", "-666666666", "18", "00602"], ["y", "abc", "18", "1"]]).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"busy")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = lambda year: f"http://127.0.0.1:{server.server_port}/acs?y={year}"
    types = {"zip code tabulation area": "string", "B19013_001E": "double"}
    try:
        pages = paged.read_pages(spark, [url(y) for y in ("2020", "2021", "none")], types, missing=["-666666666"], wait=0.01)
        assert pages.rdd.getNumPartitions() == 3
        assert Counter(tuple(r)[1:] for r in pages.collect()) == Counter({("46202", 52000.0): 2, ("00602", None): 2, ("1", None): 2}) and asked["/acs?y=2021"] >= 3
        with pytest.raises(Exception, match="404"):
            paged.read_pages(spark, [url("gone")], types, wait=0.01).collect()
        with pytest.raises(Exception, match="lacks"):
            paged.read_pages(spark, [url("2020")], {"other": "string"}).collect()
        assert paged.read_pages(spark, [], types).count() == 0
    finally:
        server.shutdown()
    with pytest.raises(OSError):
        paged.fetch(url("2020"), tries=2, wait=0.01, timeout=1)

def test_simplified_neighbours_keep_equal_borders(spark):
    from plotline.operators import geometry as G

    rng = np.random.default_rng(4)
    wave = [[10 + 0.3 * float(np.sin(k / 4)) + float(rng.normal()) * 1e-3, k / 10] for k in range(101)]  # the border between left and right, from (., 0) to (., 10)
    left = [[0, 0], *wave, [0, 10], [0, 5.0001], [0, 0]]
    hole = [[3, 3], [3, 4], [4, 4], [4, 3], [3, 3]]
    right = [*wave[::-1], [20, 0], [20, 5], [20, 10], wave[-1]]
    island = [[30 + float(np.cos(t)), float(np.sin(t))] for t in np.linspace(0, 2 * np.pi, 200)[:-1]]
    island.append(island[0])
    plug = hole[2:-1] + hole[:3]  # fills the hole, from another point on and the same way round
    shapes = {
        "left": {"type": "Polygon", "coordinates": [left, hole]}, "right": {"type": "MultiPolygon", "coordinates": [[right], [island]]}, "plug": {"type": "Polygon", "coordinates": [plug]},
        "point": {"type": "Point", "coordinates": [1, 2]}, "none": None, "flat": {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]},
    }
    df = spark.createDataFrame([(k, None if v is None else json.dumps(v)) for k, v in shapes.items()], "id string, geometry string")
    out = {r.id: json.loads(r.geometry) for r in G.simplify(df, tolerance=0.02).collect()}
    assert set(out) == {"left", "right", "plug"} and [out[k]["type"] for k in ("left", "right", "plug")] == ["Polygon", "MultiPolygon", "Polygon"]
    edges = lambda ring: {frozenset((tuple(a), tuple(b))) for a, b in zip(ring, ring[1:])}
    l, r = out["left"]["coordinates"][0], out["right"]["coordinates"][0][0]
    border = {tuple(map(float, p)) for p in wave}
    inside = lambda ring: {e for e in edges(ring) if all(p in border for p in e)}
    assert inside(l) == inside(r) and 5 < len(inside(l)) < 60
    assert edges(out["left"]["coordinates"][1]) == edges(out["plug"]["coordinates"][0])
    for ring in (l, r, out["right"]["coordinates"][1][0]):
        assert ring[0] == ring[-1] and len(ring) >= 4
    assert [0.0, 5.0001] not in l and [20.0, 5.0] not in r and 4 < len(out["right"]["coordinates"][1][0]) < 60
    near = lambda p, ring: min(abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / max(np.hypot(*np.subtract(b, a)), 1e-12) for a, b in zip(ring, ring[1:]) if min(np.hypot(*np.subtract(p, a)), np.hypot(*np.subtract(p, b))) <= np.hypot(*np.subtract(b, a)) + 0.02)
    assert max(near(p, l) for p in wave) <= 0.02 + 1e-9
    whole = {r.id: json.loads(r.geometry) for r in G.simplify(df, tolerance=1e9).collect()}  # no ring falls together
    assert all(len({tuple(p) for p in ring}) >= 3 for ring in (whole["left"]["coordinates"][0], whole["right"]["coordinates"][0][0], whole["right"]["coordinates"][1][0], whole["plug"]["coordinates"][0]))
    assert G.simplify(df.where("false")).count() == 0


def test_delimited_layouts(spark, tmp_path):
    (tmp_path / "2015.txt").write_bytes("SDF_ID|County_ID|Conveyance_Date|C6_Sales_Price\n49-1|49|03/17/2015|250000\nJos\xe9\u20ac\u201c|01|x|\n".encode("cp1252"))
    (tmp_path / "SALEDISC2021.txt").write_bytes("SDF_ID\tCounty_ID\tC7_Conveyance_Date\tE1_Sales_Price\nC1\t49\t2021-03-17\t25000000\n".encode("utf-16"))
    (tmp_path / "SaleParcel2021.TXT").write_text("x")
    found = readers.discover_annual(sorted(p.name for p in tmp_path.iterdir()))
    assert [(s["year"], s["layout"]) for s in found] == [(2015, "legacy"), (2021, "modern")]
    legacy = readers.read_sales(spark, str(tmp_path / "2015.txt"), ["Foreclosure"]).collect()
    assert {r.SDF_ID for r in legacy} == {"49-1", "Jos\xe9\u20ac\u201c"} and legacy[0].Foreclosure is None and {r.County_ID for r in legacy} == {"49", "01"}
    assert readers.read_sales(spark, str(tmp_path / "SALEDISC2021.txt")).first().E1_Sales_Price == "25000000"
    with pytest.raises(ValueError):
        readers.discover_annual(["SALEDISC2021.txt"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    root = str(tmp_path / "store")
    sinks.commit_batch("b1", {"obs": df}, spark.createDataFrame([(3,)], "rows int"), root)
    df.write.parquet(f"{root}/obs/batch_id=b2")  # a batch that broke off before its registry row
    assert sinks.committed(spark, root, "obs").count() == 3
    out = str(tmp_path / "export")
    assert sinks.export_once(df, out, "s1") and not sinks.export_once(df, out, "s1") and sinks.export_once(df, out, "s2")
    sinks.write_parquet(df.where("k > 9"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).columns == ["k", "v"]


def test_stream_ingest(spark, tmp_path):
    from plotline.streaming.ingest import ingest

    src, root = tmp_path / "in", str(tmp_path / "store")
    spark.createDataFrame([("k", 2, "new"), ("k", 1, "old"), ("j", 1, "x")], "k string, t int, v string").write.parquet(str(src))
    ingest(spark.readStream.schema("k string, t int, v string").parquet(str(src)), root, ["k"], [F.desc("t")], str(tmp_path / "cp"))
    got = W.latest(sinks.committed(spark, root, "observations"), ["k"], [F.desc("t")]).collect()
    assert {r.k: r.v for r in got} == {"k": "new", "j": "x"}


def test_event_study_keeps_the_earliest_quarter_out_of_the_reference(spark, monkeypatch):
    from plotline.plans import models

    rng = np.random.default_rng(5)
    quarters = [(y, q) for y in (1997, 1998) for q in range(4)]
    rows = [(f"{y}-{3 * q + 1:02d}-01", f"c{c}", tier, float(c % 2), float(rng.normal()), float(rng.normal()), 3.0, 3.0 if (y, q) >= (1998, 1) else 1.0) for y, q in quarters for c in range(8) for tier in models.TIERS]
    p = spark.createDataFrame(rows, "d string, county string, tier string, treated double, income double, log_price double, transactions double, rate_gap double").withColumn("m", F.to_date("d")).cache()
    d, shock, found = models.event_panel(p, 1998, 2.5)
    assert shock == 1998 * 4 + 2 and found == list(range(-5, 3)) and d.where("event_quarter = -5 and calendar_quarter = '1997Q1'").count() == 24
    with pytest.raises(ValueError, match="no month"):
        models.event_panel(p, 1997, 2.5)
    monkeypatch.setattr(models, "panel", lambda spark, sf: p)
    out = {(r.event_quarter, r.comparison): (r.estimate, r.low, r.high) for r in models.event_study(spark, "").collect()}
    assert {q for q, _ in out} == set(range(-5, 3)) and len(out) == 24
    assert all((v == (0.0, 0.0, 0.0)) == (q == -1) for (q, _), v in out.items())
    # the entry tier's effects by hand: differences of the treated and the others against the reference quarter, from dummies
    f = {"county": [f"c{c}" for c in range(8)], "quarter": ["q-1", *(f"q{q}" for q in range(-5, 3) if q != -1)], "tier": models.TIERS}
    dummies = d.withColumn("quarter", F.concat(F.lit("q"), F.col("event_quarter").cast("string")))
    plain = S.wls(dummies, F.col("log_price"), S.design(dummies, ["quarter*treated*tier", "income", "county"], f, ("treated", "income")), F.col("transactions"))
    for q in (-5, 2):
        assert out[q, "entry treated minus others"][0] == pytest.approx(plain.beta[plain.names.index(f"quarter=q{q}:treated")], rel=1e-6)
        assert out[q, "mid minus entry"][0] == pytest.approx(plain.beta[plain.names.index(f"quarter=q{q}:treated:tier=mid")], rel=1e-6)


def test_accounting_tells_which_identity_a_lost_row_breaks(spark):
    members = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True), ("c", True), ("c", False), ("d", None)], "y string, ok boolean")
    seen = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "y string")
    errors = spark.createDataFrame([("a",)], "y string")
    out = V.accounting(members, seen, errors, "y", valid="ok").collect()
    got = {r.y: (r.members, r.observations, r.error_events, r.members_balance, r.observations_match_valid, r.quarantine_events_match, r.balanced) for r in out}
    assert got == {
        "a": (2, 1, 1, True, True, True, True),
        "b": (2, 1, 0, True, False, True, False),
        "c": (2, 1, 0, True, True, False, False),
        "d": (1, 0, 0, False, True, True, False),
        "e": (0, 1, 0, True, False, True, False),
    }


def test_stream_results_are_files_and_stay_out_of_the_driver(spark, tmp_path):
    from plotline.streaming.ingest import latest_by_event_time, run_once

    schema, src = "k string, t int, v string", str(tmp_path / "in")
    for part in ([("k", 2, "new"), ("j", 1, "x")], [("k", 1, "old"), ("j", 3, "y")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    # a file a batch: in complete mode only the last batch is the result
    out = run_once(latest_by_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "k", ["t"], ["v"]))
    assert out.inputFiles() and {(r.k, r.versions, r.v) for r in out.collect()} == {("k", 2, "new"), ("j", 2, "y")} and out.count() == 2
    (tmp_path / "none").mkdir()
    assert run_once(latest_by_event_time(spark.readStream.schema(schema).parquet(str(tmp_path / "none")), "k", ["t"], ["v"])).count() == 0


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, g = rng.normal(size=n), rng.integers(0, 4, n)
    y = 1 + 2 * x + 0.5 * (g == 2) + rng.normal(size=n)
    df = spark.createDataFrame([Row(y=float(a), x=float(b), dup=float(3 * b), g=f"g{c}", c=int(c)) for a, b, c in zip(y, x, g)])
    cols = S.design(df, ["x", "dup", "g"], {"g": ["g0", "g1", "g2", "g3"]}, ("x", "dup"))
    fit = S.wls(df, F.col("y"), cols)
    assert fit.dropped == ["dup"]
    m = np.column_stack([np.ones(n), x, *[(g == k).astype(float) for k in (1, 2, 3)]])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    assert np.allclose(fit.beta, b)
    e, inv = y - m @ b, np.linalg.inv(m.T @ m)
    assert np.allclose(S.classical_vcov(fit), inv * (e @ e) / (n - 5))
    assert np.allclose(S.hc1_vcov(df, fit), inv @ (m.T * e**2) @ m @ inv * n / (n - 5))
    s = np.array([(m[g == k] * e[g == k, None]).sum(0) for k in range(4)])
    assert np.allclose(S.cluster_vcov(df, fit, "c"), inv @ s.T @ s @ inv * 4 / 3 * (n - 1) / (n - 5))
    scores = S.cluster_scores(df, fit, "c")
    boot = S.wild_bootstrap(fit, scores, [1, 2], 999).orderBy("term").collect()
    one_part = S.wild_bootstrap(fit, scores.repartition(7), [1, 2], 999).orderBy("term").collect()
    assert [r.draws for r in boot] == [999, 999] and np.allclose([r[1:5] for r in boot], [r[1:5] for r in one_part])
    r = next(r for r in boot if r.term == fit.names[1])
    # the draws' spread is that of weights of variance 1 on the clusters' shares
    expected = 1.96 * np.sqrt(((s @ inv[:, 1]) ** 2).sum())
    assert r.low < fit.beta[1] < r.high and 0 < r.p_value <= 1 and abs((r.high - r.low) / 2 / expected - 1) < 0.25
    with pytest.raises(Exception, match="too few draws"):
        S.wild_bootstrap(fit, scores, [1], 50).collect()
    stat, k = S.wald(fit.beta[1:2], S.classical_vcov(fit)[1:2, 1:2])
    assert k == 1 and stat > 100


def test_pairs_bootstrap_against_whole_resamples(spark):
    rng = np.random.default_rng(8)
    n, groups = 3000, 300
    g = rng.integers(0, groups, n)
    x = rng.normal(size=n) + rng.normal(size=groups)[g]
    y = 1 + 2 * x + rng.normal(size=groups)[g] + rng.normal(size=n)
    df = spark.createDataFrame([Row(y=float(a), x=float(b), c=int(c), s=f"s{c % 2}") for a, b, c in zip(y, x, g)])
    cols = {"(Intercept)": F.lit(1.0), "x": F.col("x")}
    draws = S.pairs_bootstrap(df, F.col("y"), cols, "c", reps=400, strata="s").orderBy("draw").collect()
    again = S.pairs_bootstrap(df.repartition(5), F.col("y"), cols, "c", reps=400, strata="s").orderBy("draw").collect()
    got = np.array([r.beta for r in draws])
    assert got.shape == (400, 2) and np.allclose(got, [r.beta for r in again])  # whatever the partitioning
    # a plain version: resample the clusters of each stratum, stack their rows, solve
    plain = []
    for _ in range(400):
        rows = np.concatenate([np.flatnonzero(g == c) for k in (0, 1) for c in rng.choice([c for c in range(groups) if c % 2 == k and (g == c).any()], sum(1 for c in range(groups) if c % 2 == k and (g == c).any()))])
        m = np.column_stack([np.ones(len(rows)), x[rows]])
        plain.append(np.linalg.lstsq(m, y[rows], rcond=None)[0])
    assert np.allclose(np.quantile(got, [0.025, 0.5, 0.975], axis=0), np.quantile(plain, [0.025, 0.5, 0.975], axis=0), atol=0.03)
    r = S.slope_ratio(S.pairs_bootstrap(df, F.col("y"), cols, "c", reps=400), [1], [0], 2.0, reps=400).first()
    assert r.low < 2 < r.high and r.benchmark == 4.5 and r.p_value == pytest.approx(1 / 401) and r.draws == 400


def test_special_functions(spark):
    import math

    from plotline.functions import special as P

    at = lambda f, *rows: np.array([r[0] for r in spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "i int, a double, b double, x double").orderBy("i").select(f).collect()], float)
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    near = lambda got, want: np.allclose(got, want, rtol=1e-10, atol=0)
    z = [0.0, 1e-3, 0.5, 1.7, 1.7320508, 3, 8, 37]
    assert near(at(P.normal_p(a), *[(v, 0, 0) for v in z]), [math.erfc(v / math.sqrt(2)) for v in z])
    assert near(at(P.erfc(a), *[(v, 0, 0) for v in (-3, -0.1, 0, 2)]), [math.erfc(v) for v in (-3, -0.1, 0, 2)])
    assert near(at(P.lgamma(a), *[(v, 0, 0) for v in (0.01, 0.5, 3.3, 15.9, 16.1, 1e6)]), [math.lgamma(v) for v in (0.01, 0.5, 3.3, 15.9, 16.1, 1e6)])
    # Student's t of 1, 2 and 4 degrees of freedom has closed forms; with many it is nearly normal
    t = [0.0, 1e-4, 0.5, 2.0, 40.0, 1e6]
    one = [2 * math.atan2(1, v) / math.pi for v in t]
    two = [2 / (math.sqrt(v * v + 2) * (math.sqrt(v * v + 2) + v)) for v in t]
    assert near(at(P.student_p(a, b), *[(v, 1, 0) for v in t]), one) and near(at(P.student_p(a, b), *[(-v, 2, 0) for v in t]), two)
    assert near(at(P.student_p(a, b), (1.96, 1e14, 0)), math.erfc(1.96 / math.sqrt(2)))
    below, above = at(P.student_p(a, b), (2.5, 1e6, 0), (2.5, 1e6 + 1, 0))
    assert abs(below / above - 1) < 1e-10
    # chi-squared with an even number of degrees of freedom is a Poisson sum, the beta function with whole arguments a binomial one
    chi = lambda s, k: math.fsum(math.exp(j * math.log(s / 2) - s / 2 - math.lgamma(j + 1)) for j in range(k // 2))
    cases = [(3, 2), (10, 4), (1, 10), (200, 10), (100, 100), (130, 100), (1000, 1000)]
    assert near(at(P.chi2_p(a, b), *[(*c, 0) for c in cases]), [chi(*c) for c in cases])
    binom = lambda p, q, v: math.fsum(math.comb(p + q - 1, j) * v**j * (1 - v) ** (p + q - 1 - j) for j in range(p, p + q))
    cases = [(3, 5, 0.2), (30, 21, 0.6), (1, 1, 0.3), (200, 300, 0.4), (2, 3, 0.0), (2, 3, 1.0)]
    assert near(at(P.beta_inc(a, b, x), *cases), [binom(*c) for c in cases])
    assert spark.range(1).select(P.student_p(F.lit(None).cast("double"), 3.0), P.student_p(1.0, -1.0), P.gamma_q(-1.0, 1.0), P.beta_inc(1.0, 1.0, 2.0)).first()[:] == (None, None, None, None)


def test_absorbed_effects_equal_dummies(spark):
    from plotline.operators import absorb as AB

    rng = np.random.default_rng(5)
    n = 600
    a, m, t = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.integers(0, 2, n)
    keep = ~((a < 3) & (m < 4))  # unbalanced
    a, m, t = a[keep], m[keep], t[keep]
    n = len(a)
    x = rng.normal(size=n) + 0.3 * a
    y = 2 * x - 0.5 * t + rng.normal(size=12)[a] + rng.normal(size=9)[m] + rng.normal(size=n)
    w = rng.integers(1, 5, n).astype(float)
    rows = [Row(y=float(p), x=float(q), t=float(r), a=f"a{u}", m=int(v), w=float(z), same=float(u)) for p, q, r, u, v, z in zip(y, x, t, a, m, w)]
    rows += [Row(y=None, x=1.0, t=0.0, a="a1", m=1, w=1.0, same=1.0), Row(y=1.0, x=1.0, t=0.0, a=None, m=1, w=1.0, same=1.0), Row(y=9.0, x=1.0, t=0.0, a="a1", m=1, w=0.0, same=1.0)]
    df = spark.createDataFrame(rows)
    cols = {"(Intercept)": F.lit(1.0), "x": F.col("x"), "t": F.col("t"), "same": F.col("same")}
    rows, fit = AB.fit_absorbed(df, "y", cols, ["a", "m"], F.col("w"))
    dummies = S.design(df, ["x", "t", "a", "m"], {"a": [f"a{k}" for k in range(12)], "m": list(range(9))}, ("x", "t"))
    plain = S.wls(df.where("w > 0 and a is not null"), F.col("y"), dummies, F.col("w"))
    at = [plain.names.index(c) for c in ("x", "t")]
    assert fit.names == ["x", "t"] and fit.dropped == ["same"] and (fit.n, fit.k) == (plain.n, plain.k)
    assert np.allclose(fit.beta, plain.beta[at], rtol=1e-8) and fit.rss == pytest.approx(plain.rss, rel=1e-8)
    assert np.allclose(S.classical_vcov(fit), S.classical_vcov(plain)[np.ix_(at, at)], rtol=1e-7)
    assert np.allclose(S.cluster_vcov(rows, fit, "a"), S.cluster_vcov(df.where("w > 0 and a is not null"), plain, "a")[np.ix_(at, at)], rtol=1e-7)
    # two groups of levels that never meet take a coefficient more
    parts = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", float(i * j + (i == 1) + ord(g))) for g in "pq" for i in range(3) for j in range(3)], "a string, b string, x double")
    assert AB.absorb(parts, {"x": F.col("x")}, ["a", "b"])[1] == 6 + 6 - 2 and AB.absorb(parts, {"x": F.col("x")}, ["a"])[1] == 6


def test_ten_thousand_levels(spark):
    from plotline.operators import absorb as AB

    rng = np.random.default_rng(6)
    n, g, h = 60_000, 10_000, 12
    a, b = np.concatenate([np.arange(g), rng.integers(0, g, n - g)]), rng.integers(0, h, n)
    x = rng.normal(size=n)
    y = 3 * x + rng.normal(size=g)[a] + rng.normal(size=h)[b] + rng.normal(size=n)
    rows, fit = AB.fit_absorbed(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "x": x, "y": y})), "y", {"x": F.col("x")}, ["a", "b"])
    # the second factor as dummies and the first by its means: exact
    means = lambda v: v - (np.bincount(a, v, g) / np.bincount(a, minlength=g))[a]
    m = np.column_stack([means(x), *[means((b == k).astype(float)) for k in range(1, h)]])
    assert abs(fit.beta[0] / np.linalg.lstsq(m, means(y), rcond=None)[0][0] - 1) < 1e-8 and fit.k == 1 + g + h - 1


def test_many_fits_equal_single_ones(spark):
    from plotline.operators import absorb as AB

    rng = np.random.default_rng(7)
    n = 500
    df = spark.createDataFrame([Row(y=float(rng.normal()), z=float(rng.normal()) if i % 7 else None, x=float(rng.normal()), v=float(rng.normal()), g=int(i % 11), w=float(1 + i % 3)) for i in range(n)])
    cols = {"(Intercept)": F.lit(1.0), "x": F.col("x"), "v": F.col("v")}
    models = {"all": (F.lit(True), "y", list(cols)), "some": (F.col("g") < 6, "y", ["(Intercept)", "v"]), "other": (F.col("x") > -1, "z", list(cols)), "without": (F.col("g") != 3, "z", ["(Intercept)", "x"])}
    fits, v = AB.fit_many(df, {"y": F.col("y"), "z": F.col("z")}, cols, models, F.col("w"), cluster="g")
    for name, (keep, y, own) in models.items():
        d = df.where(keep)
        one = S.wls(d, F.col(y), {c: cols[c] for c in own}, F.col("w"))
        assert fits[name].names == one.names and fits[name].n == one.n and np.allclose(fits[name].beta, one.beta) and fits[name].rss == pytest.approx(one.rss)
        assert np.allclose(v[name], S.cluster_vcov(d, one, "g"))


def test_poisson_score_is_zero(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = rng.poisson(np.exp(0.3 + 0.5 * x))
    df = spark.createDataFrame([Row(y=float(a), x=float(b)) for a, b in zip(y, x)])
    fit = S.poisson(df, F.col("y"), S.design(df, ["x"], {}, ("x",)))
    mu = np.exp(fit.beta[0] + fit.beta[1] * x)
    assert abs((y - mu).sum()) < 1e-6 and abs(((y - mu) * x).sum()) < 1e-6


def test_terms_and_names(spark):
    assert S.select_term(["a", "a:b", "c"], ["a"], ["b"]) == "a"
    with pytest.raises(ValueError):
        S.select_term(["a", "a:b"], ["a"])
    assert X.snake_case("totPurchaseAmt") == "tot_purchase_amt"
    allowed = "seller_paid_points buyer_part_interest name_change county_name property_zip city related_party".split()
    blocked = "buyer_name seller_phone grantee email mailing_zip title_company name third_party street1".split()
    df = spark.createDataFrame([tuple("x" for _ in allowed + blocked)], ", ".join(f"{c} string" for c in allowed + blocked))
    assert X.party_columns(df) == blocked
    assert one(spark, X.holds_party_text(F.lit("call 612-555-0100"))) and not one(spark, X.holds_party_text(F.lit("parcel 27-053-1234")))


def test_features_and_tables(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('{"features": [{"properties": {"zip": "46202"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    r = readers.read_features(spark, str(p)).first()
    assert r.properties["zip"] == "46202" and "Point" in r.geometry
    assert [tuple(x) for x in readers.rows_with_header(spark, [["A", "B"], ["1", None]]).collect()] == [("1", None)]
    (tmp_path / "t.csv").write_text("zip\n00602\n")
    assert readers.read_table(spark, str(tmp_path / "t")).first().zip == "00602"
    _ = io


def test_index_and_tier_guards(spark):
    from plotline.operators import panel as P

    days = lambda rows, names: spark.createDataFrame(rows, names)
    twice = days([("2025-01-01", 100.0, 1), ("2025-01-01", 90.0, 2), ("2025-02-01", 104.0, 1)], "d string, cpi double, nth int").withColumn("d", F.to_date("d"))
    with pytest.raises(ValueError):
        P.monthly_index(twice, "d", "cpi")
    assert [r.cpi for r in P.monthly_index(twice, "d", "cpi", last_by="nth").orderBy("month_start").collect()] == [90.0, 104.0]
    with pytest.raises(ValueError):
        P.monthly_index(twice, "d", "cpi", last_by="nth", last="2025-03-01")
    index = P.monthly_index(twice, "d", "cpi", last_by="nth")
    sales = days([("2025-01-01", 10.0), ("2025-07-01", 10.0)], "d string, price double").withColumn("m", F.to_date("d"))
    with pytest.raises(Exception, match="no index for the month"):
        P.real_price(sales, index, price="price", month="m", value="cpi", base_year=2025).collect()
    with pytest.raises(Exception, match="base year"):
        P.real_price(sales.limit(1), index, price="price", month="m", value="cpi", base_year=1999).collect()
    prices = days([(i, "A" if i % 2 else "B", float(100 + i % 7 + 1000 * (i % 3))) for i in range(60)], "k long, g string, p double")
    fits = {r.g: r for r in P.tier_breaks_by(prices, "p", "g", key="k", least=20).collect()}
    assert set(fits) == {"A", "B"} and all(106 < r.entry_boundary < 1100 < 1106 < r.high_end_boundary < 2100 for r in fits.values())
    again = {r.g: r.cohort for r in P.tier_breaks_by(prices.repartition(5), "p", "g", key="k", least=20).collect()}
    assert again == {g: r.cohort for g, r in fits.items()}
    with pytest.raises(Exception, match="too few"):
        P.tier_breaks_by(prices, "p", "g", key="k").collect()
    raw = days([(float(v + i),) for v in (100, 500, 900, 1300) for i in range(5)] + [(9e9,)], "p double")
    assert P.raw_tier_breaks(raw, "p", expected=(302, 702), tolerance=5) == [302.0, 702.0]
    with pytest.raises(ValueError):
        P.raw_tier_breaks(raw, "p", expected=(400, 702), tolerance=5)


def test_order_statistics_with_ties_nulls_and_empty(spark):
    from plotline.operators import aggs as A

    rows = [("a", float(v)) for v in [5, 5, 5, 5, 1, 9, -3]] + [(None, 2.0), (None, 4.0), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q1, r.q2) for r in A.quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    assert got == {"a": (3.0, 5.0), None: (2.5, 3.0), "c": (7.0, 7.0)}
    assert [r.m for r in A.quantiles(df, [], "v", {"m": 0.5}).collect()] == [5.0]
    assert A.quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    many = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 == 0, 1.0).otherwise(F.pow(F.col("id") % 997, 3)).alias("v"))
    want = {r.g: r.m for r in many.groupBy("g").agg(F.percentile("v", F.lit(0.9)).alias("m")).collect()}
    assert {r.g: r.m for r in A.quantiles(many, ["g"], "v", {"m": 0.9}).collect()} == want


def test_contracts_reject_other_counties_and_repeated_keys(spark):
    from plotline.operators import disclosures as D

    raw = spark.createDataFrame([(" 12-A ", "6", "03/17/2015", "100000", "46032-1", "p", "510", "Y", "Y"), ("12-A", "06", "2015-03-17", "100000", "46032", "p", "510", "Y", "N"), ("b d", "77", "x", "", None, None, None, None, None)], "SDF_ID string, County_ID string, Conveyance_Date string, C6_Sales_Price string, PropZip string, Parcel1 string, P2_6_Prop_Class_Code string, P2_16_Valid_Trending string, P2_17_Validation_Complete string")
    rows = D.normalize_legacy(raw, year=2015, file="f", counties={"06": ("Boone", "18011", "X")})
    assert rows.columns == D.COLUMNS
    history, disposed = D.combine_sources(rows)
    kept = history.collect()
    assert [(r.source_key, r.county, r.valid_for_trending, r.validation_complete, r.source_status_conflict) for r in kept] == [("IN:SDF:12-A", "Boone", True, None, True)]
    assert sorted(r.disposition for r in disposed.where("not kept").collect()) == ["invalid_key", "status_variant"]
    assert all(r.balanced for r in D.source_funnel(rows, history, disposed, ["source_year", "source_format"]).collect())
