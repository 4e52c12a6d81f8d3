"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that disclose them (native).

Emails, IP addresses, card and phone numbers are found by pattern. Each distinct value is a protected entity, and so is
what values share: an email's domain, an IP address's first three bytes, a card's issuer, a phone number's first digits.
All terms of the documents that mention an entity are weighed by corpus co-occurrence: with p(e) the share of texts that
mention entity e and p(e|t) the share of the texts with term t that mention e, the pointwise mutual information of t and
e is IC(e) + log2 p(e|t), IC(e) = -log2 p(e). A term that carries GENERALISE of IC(e) or more is generalised wherever it
stands in the documents that mention e, to what kind of term it is (a name, an acronym or a plain word); one that carries
REMOVE of it is removed. Distinct texts are counted, so that copies of one document reveal nothing by themselves.

Java's regular expressions recurse on repeated groups, which breaks on long runs; the patterns here are equal ones made
of character classes only, over a text in which characters that end a match are first replaced one for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import keyed, write_table

#: Order of the kinds at one start, and what replaces each: terms are generalised to a word, a name or an acronym.
KINDS = ("email", "ip", "card", "phone", "generalise", "generalise", "generalise", "remove")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "[NAME]", "[ACRONYM]", "")
WORD, REMOVED = 4, 7
GENERALISE, REMOVE = 0.9, 0.97
#: A term this share of all terms or rarer may meet its texts in one task.
FREQUENT = 1e-4
_DOT = "﷐"  #: stands for a dot that no label follows; a noncharacter
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.\p{L})"
_LOCAL = rf"[A-Za-z0-9._%+{_DOT}-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: In every text with a span that holds, by kind; cheap to look for, so that no other text is shuffled.
SIGNS = (
    r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:[0-9][\x20-]?){13}[0-9]", r"\+[0-9](?:[\x20().-]*+[0-9]){9}",
)


def may_hold(text: Column) -> Column:
    """Whether a text can have a pattern match that holds."""
    return (text.contains("@") & text.rlike(SIGNS[0])) | text.rlike(SIGNS[1]) | text.rlike(SIGNS[2]) | (text.contains("+") & text.rlike(SIGNS[3]))


def _matches(kind: int, text: Column, pattern: str, when: Column) -> Column:
    """array<struct<kind, nth, gap, len, value>> of the matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"))
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), x["m"].alias("value"))
    return F.when(when, F.transform(zipped, one)).otherwise(F.array())


def _starts(*by: str) -> Column:
    """Where the nth match starts, from the matches' lengths and the gaps before them."""
    past = Window.partitionBy(*by).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return (F.coalesce(F.sum(F.col("gap") + F.col("len")).over(past), F.lit(0)) + F.col("gap")).cast("long")


def _luhn(digits: Column) -> Column:
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int"))
    cells = F.filter(F.split(F.reverse(digits), "", -1), lambda c: c != "")
    return F.aggregate(F.transform(cells, one), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(rows: DataFrame) -> DataFrame:
    """(_rid, kind, start, end, entities) of the pattern matches that hold, from (_rid, text)."""
    text, rows = F.col("text"), rows.where(may_hold(F.col("text")))
    emails = F.regexp_replace(F.translate(text, _DOT, "\n"), r"\.(?![A-Za-z0-9-])", _DOT)
    # single separators only: of two or more in a row each becomes a line end
    cards = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "\n")
    all_ = F.concat(
        _matches(0, emails, EMAIL, text.contains("@")),
        _matches(1, text, IP, text.rlike(r"[0-9]\.[0-9]")),
        _matches(2, cards, CARD, text.rlike("[0-9]")),
        _matches(3, text, PHONE, text.rlike(r"\+[0-9]")),
    )
    m = rows.select("_rid", F.inline(all_)).repartition("_rid")
    start = _starts("_rid", "kind")
    m = m.select("_rid", "kind", "value", start.alias("start"), (start + F.col("len")).alias("end"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    holds = (
        (F.col("kind") == 0)
        | ((F.col("kind") == 1) & F.col("value").rlike(rf"\A{byte}\.{byte}\.{byte}\.{byte}\z"))
        | ((F.col("kind") == 2) & n.between(14, 19) & _luhn(F.when(n.between(14, 19), digits).otherwise("")))
        | ((F.col("kind") == 3) & n.between(10, 15))
    )
    name = F.when(F.col("kind") == 0, F.lower(F.translate("value", _DOT, "."))).when(F.col("kind") == 1, F.col("value")).otherwise(digits)
    family = F.when(F.col("kind") == 0, F.substring_index(name, "@", -1)).when(F.col("kind") == 1, F.substring_index(name, ".", 3)).otherwise(F.substring(name, 1, 6))
    entities = F.array(F.xxhash64("kind", name), F.xxhash64(F.lit("family"), "kind", family))
    return m.where(holds).select("_rid", "kind", "start", "end", entities.alias("entities"))


def _copies(rows: DataFrame) -> DataFrame:
    """(_rid) of all but one of the rows of each text."""
    ids = rows.select("_rid", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    # written, so that the join has two plain shuffles and the rows of one text can be split
    firsts = write_table(ids.groupBy("h", "g").agg(F.min("_rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pii-texts")
    return ids.join(firsts, ["h", "g"]).where("_rid <> first").select("_rid")


def _terms(rows: DataFrame, *columns: str) -> DataFrame:
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))
    return rows.select(*columns, F.explode(words).alias("term"))


def _pairs(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, int]:
    """(_rid, entity, term, copy, n_e, n_t) of the documents' entities and terms, with the texts that hold each, and the
    number of texts. Of the pairs only those are left out that cannot disclose: with n_et <= n_e, a term tells GENERALISE
    of IC(e) only if n_t <= n_e * (N / n_e) ** (1 - GENERALISE)."""
    copies = write_table(_copies(rows), "pii-copies")
    n_texts = rows.count() - copies.count()
    mentions = write_table(spans.select("_rid", F.explode("entities").alias("entity")).distinct().join(copies.withColumn("copy", F.lit(True)), "_rid", "left").withColumn("copy", F.coalesce("copy", F.lit(False))), "pii-mentions")
    held = write_table(_terms(rows.join(copies, "_rid", "left_anti")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "pii-held")
    entities = mentions.where("not copy").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    most = entities.agg(F.max("n_e")).first()[0] or 1
    # a little more than the bound, for rounding
    bound = lambda n_e: n_e * F.pow(F.lit(float(n_texts)) / n_e, F.lit(1 - GENERALISE)) * F.lit(1 + 1e-9)
    top = most * (n_texts / most) ** (1 - GENERALISE) * (1 + 1e-9)
    # the most frequent terms go before their rows meet in one task; there are at most 1 / FREQUENT of them
    total = held.agg(F.sum("n_t")).first()[0] or 0
    frequent = held.where(F.col("n_t") > max(top, total * FREQUENT)).select("term")
    terms = _terms(rows.where(may_hold(F.col("text"))), "_rid").join(F.broadcast(frequent), "term", "left_anti")
    terms = terms.join(mentions.select("_rid").distinct(), "_rid", "left_semi")
    terms = terms.join(held.where(F.col("n_t") <= top), "term")
    known = mentions.join(entities.where("n_e > 1"), "entity", "left").withColumn("n_e", F.coalesce("n_e", F.lit(1).cast("long")))
    pairs = terms.join(known, "_rid").where(F.col("n_t") <= bound(F.col("n_e")))
    return write_table(pairs.select("_rid", "entity", "term", "copy", "n_e", "n_t"), "pii-pairs"), n_texts


def disclosing_terms(pairs: DataFrame, n_texts: int) -> DataFrame:
    """(entity, term, kind): what terms tell about the entities of their documents, by counts over all texts."""
    counts = pairs.groupBy("entity", "term").agg(F.count_if(~F.col("copy")).alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    ic = F.log2(F.lit(float(n_texts)) / F.col("n_e"))
    pmi = ic + F.log2(F.least(F.lit(1.0), F.col("n_et") / F.col("n_t")))
    share = F.when(ic > 0, pmi / ic)
    return counts.select("entity", "term", F.when(share >= REMOVE, F.lit(REMOVED)).when(share >= GENERALISE, F.lit(WORD)).alias("kind")).where("kind is not null")


def _occurrences(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(_rid, kind, start, end) of every occurrence of the terms told, (_rid, term, kind), in their documents."""
    found, gaps = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    one = lambda x, i: F.struct(i.alias("nth"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.lower(x["m"]).alias("term"), F.when(x["m"].rlike(r"^\p{Lu}+$"), 2).when(x["m"].rlike(r"^\p{Lu}"), 1).otherwise(0).alias("shape"))
    matches = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")), one)
    m = rows.where(may_hold(F.col("text"))).join(told.select("_rid").distinct(), "_rid", "left_semi").select("_rid", F.inline(matches)).repartition("_rid")
    start = _starts("_rid")
    m = m.select("_rid", "term", "shape", start.alias("start"), (start + F.col("len")).alias("end"))
    kind = F.when(F.col("kind") == WORD, F.col("kind") + F.col("shape")).otherwise(F.col("kind"))
    return m.join(told, ["_rid", "term"]).select("_rid", kind.alias("kind"), "start", "end")


def all_spans(rows: DataFrame) -> DataFrame:
    """(_rid, kind, start, end) of all spans, pattern matches and disclosing terms, from (_rid, text)."""
    base = write_table(base_spans(rows), "pii-base")
    pairs, n_texts = _pairs(rows, base)
    told = pairs.join(disclosing_terms(pairs, n_texts), ["entity", "term"]).groupBy("_rid", "term").agg(F.max("kind").alias("kind"))
    extra = _occurrences(rows, write_table(told, "pii-told"))
    return base.select("_rid", "kind", "start", "end").unionByName(extra)


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    return keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row), "doc_id", "pii-rows")


def find_personal(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base and spans (texts of kind:start:end by start,
    then kind, comma-joined; code points, end exclusive). Null and empty texts have none. Repeated and null ids are
    documents of their own. An empty table gives no rows; extra columns are ignored."""
    rows = _rows(docs, id_col, text_col, False)
    s = all_spans(rows)
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    g = s.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("a"), *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(4)])
    g = g.select("_rid", *[f"n_{KINDS[k]}" for k in range(4)], text(F.filter("a", lambda x: x["kind"] < 4)).alias("base"), text(F.col("a")).alias("spans"))
    out = rows.select("_rid", "doc_id").join(g, "_rid", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{KINDS[k]}", F.lit(0)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitize(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span in its text replaced by its kind's mark; spans that overlap become the first one's mark.
    Null texts stay null."""
    rows = _rows(docs, id_col, text_col, True)
    s = all_spans(rows.select("_rid", "text")).repartition("_rid")
    by = Window.partitionBy("_rid").orderBy("start", "kind", "end")
    s = s.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("run", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(by))
    runs = s.groupBy("_rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind")).alias("first"))
    g = runs.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("first.kind").alias("kind")))).alias("a"))
    marks = F.array(*[F.lit(m) for m in MARKS])
    both = rows.join(g, "_rid", "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("a.end"))
    parts = F.transform("a", lambda x, i: F.concat(F.substring(F.col("text"), (F.element_at(ends, i + 1) + 1).cast("int"), (x["start"] - F.element_at(ends, i + 1)).cast("int")), F.element_at(marks, x["kind"] + 1)))
    tail = F.substring(F.col("text"), (F.element_at(ends, -1) + 1).cast("int"), F.length("text"))
    clean = F.when(F.col("a").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return both.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_information_privacy(spark, sf_dir: str) -> DataFrame:
    out = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
