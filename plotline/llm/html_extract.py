"""Main text of web pages by site template removal.

Each block subtree, inside the article or outside, is hashed; Spark counts, per host, the different page contents with
which a hash occurs. Containers that recur with MIN_PAGES of them are deleted; a paragraph, heading or list item by itself
may be a phrase that authors use again, so it must recur with a SHARE of the host's page contents as well. Copies of one
page count once, so that they are no templates of each other. What HTML itself marks as no part of the article (navigation, headers, footers,
asides, forms, scripts, and elements whose class, id or role says so) is deleted too, and where an article or main
element holds text, everything outside it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import keyed, write_table

#: A subtree is template text from so many different pages of its host, however many pages the host has.
MIN_PAGES = 5
#: The share of a host's different pages that a subtree of prose alone must be on besides.
SHARE = 0.5

#: Elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
CHROME = frozenset("head nav header footer aside form button dialog menu figure-ad".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th tr summary legend option".split())
CLOSES_P = BLOCK - {"html", "body", "head", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "legend", "figcaption", "summary"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side header footer masthead topbar toolbar share sharing social related recommended "
    "newsletter subscribe signup login comment comments reply replies respond disqus contentinfo complementary search pagination pager".split()
)
MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>""",
    re.S,
)
LABEL = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACES = re.compile(r"\s+")


def _labels(rest: str) -> str:
    return " ".join("".join(m) for m in LABEL.findall(rest)).lower() if "=" in rest else ""


def parse(page: str, templates: frozenset[int] | set[int] = frozenset(), hashes: set[int] | None = None) -> str:
    """The main text of a page. ``hashes`` collects the hashes of the block subtrees that hold text, but for the article
    and what encloses it; subtrees whose hash is in ``templates`` are deleted."""
    hashing, article = hashes is not None or bool(templates), False
    names, marks, drops, mains, inner = ["#"], [""], [False], [False], [[]]  # the open elements
    owners: list[tuple[int, ...]] = [()]  # places of their first pieces
    pieces: list[tuple[str, bool]] = []  # text, or "" for the edge of a block; whether it is in the article
    at, size = 0, len(page)
    find = MARKUP.search

    def add(text: str) -> None:
        nonlocal article
        if not drops[-1]:
            article = article or (mains[-1] and bool(text) and not text.isspace())
            pieces.append((text, mains[-1]))
        inner[-1].append(text)

    def shut() -> None:
        name, mark, drop, main, parts, begin = names.pop(), marks.pop(), drops.pop(), mains.pop(), inner.pop(), owners.pop()
        if name in BLOCK:
            pieces.append(("", main))
        if not hashing:
            return
        if main and not mains[-1]:
            inner[-1].append("\0")  # the article, and what holds it, is never a template
            return
        if "\0" in parts:
            inner[-1].append("\0")
            return
        flat = SPACES.sub(" ", "".join(parts)).strip()
        if not flat:
            return
        whole = f"<{name} {mark}>{flat}</>"
        if name in BLOCK and not drop:
            h = int.from_bytes(blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            h = h & ~1 | (name in PROSE)  # the lowest bit tells prose from containers
            if hashes is not None:
                hashes.add(h)
            if h in templates:
                del pieces[begin[0] :]
                pieces.append(("", main))
            inner[-1].append(f"<{h}>")
            return
        inner[-1].append(whole)

    while at < size:
        m = find(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["tag"] or m["tag2"] or "").lower()
        if not name:
            continue
        rest = m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if name in names:
                while names[-1] != name:
                    shut()
                shut()
            elif name == "br":
                add(" ")
            continue
        if name in RAW:
            if not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if name in VOID:
            if name == "hr" and not drops[-1]:
                pieces.append(("", mains[-1]))
            elif name == "br":
                add(" ")
            continue
        if name in CLOSES_P and "p" in names:
            while "p" in names:
                shut()
        if name in SELF_CLOSING:
            same, within = SELF_CLOSING[name]
            for k in range(len(names) - 1, 0, -1):
                if names[k] in within:
                    break
                if names[k] in same:
                    while len(names) > k:
                        shut()
                    break
        mark = _labels(rest)
        main = mains[-1] or name in ("article", "main")
        chrome = name in CHROME or (bool(mark) and name not in ("html", "body", "article", "main") and not CHROME_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", mark)))
        if name in BLOCK:
            pieces.append(("", main))
        names.append(name), marks.append(mark), drops.append(drops[-1] or chrome or "hidden" in rest.lower().split()), mains.append(main), inner.append([]), owners.append((len(pieces),))
    while len(names) > 1:
        shut()
    blocks, run = [], []
    for text, main in [*pieces, ("", False)]:
        if text == "":
            if run:
                got = SPACES.sub(" ", html.unescape("".join(run))).strip()
                if got:
                    blocks.append(got)
                run = []
        elif main or not article:
            run.append(text)
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null html is empty; a null url's pages share one host. Repeated ids
    are pages of their own, but the same subtree counts once for all pages of a host with one text."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = keyed(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.xxhash64(host).alias("host")), "page_id", "html-pages")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, contents = [], []
            for text in b.column(2):
                hashes: set[int] = set()
                content = parse(text.as_py(), hashes=hashes)
                contents.append(int.from_bytes(blake2b(content.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                found.append(list(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(contents, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["_rid", "host", "content", "found"])

    seen = write_table(rows.select("_rid", "host", "html").mapInArrow(collect, "_rid long, host long, content long, found array<long>"), "html-trees")
    trees = seen.select("_rid", "host", "content", F.explode("found").alias("h"))
    often = write_table(trees.groupBy("host", "h").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= min_pages), "html-often")
    # written, so that the join has two plain shuffles and a large host's rows can be split
    contents = write_table(seen.groupBy("host").agg(F.count_distinct("content").alias("contents")), "html-hosts")
    prose = (F.col("h") % 2) != 0
    known = often.where(~prose).select("host", "h").unionByName(often.where(prose).join(contents, "host").where(F.col("n") >= F.col("contents") * share).select("host", "h"))
    templates = trees.select("_rid", "host", "h").join(known, ["host", "h"]).groupBy("_rid").agg(F.collect_set("h").alias("templates"))
    both = rows.select("_rid", "page_id", "url", "html").join(templates, "_rid", "left").select("page_id", "url", "html", "templates")
    schema = rows.select("page_id", "url").schema.add("text", "string")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [parse(t.as_py(), set(h.as_py() or ())) for t, h in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(clean, schema).withColumn("n_chars", F.length("text").cast("long"))


def op7_template_removal(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
