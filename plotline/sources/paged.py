"""Paged web answers as a data source: one page a partition, fetched by the tasks, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that are worth another try.
AGAIN = (408, 425, 429, 500, 502, 503, 504)
TRIES, WAIT, TIMEOUT = 5, 1.0, 60


def fetch(url: str, *, tries: int = TRIES, wait: float = WAIT, timeout: float = TIMEOUT) -> bytes:
    """The body behind a URL. A lost connection or an answer of AGAIN is tried again after ``wait`` seconds, twice as long
    each time; any other error answer, or the last failure, raises."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or n + 1 == tries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if n + 1 == tries:
                raise
        time.sleep(wait * 2**n)
    raise AssertionError


def rows_of(body: bytes, header: Sequence[str]) -> list[list[str | None]]:
    """The rows of an answer that is an array of arrays, header first, in the order of ``header``; a name that the answer's
    header lacks raises, others are left out. An empty answer has no rows."""
    table = json.loads(body) if body.strip() else []
    if not table:
        return []
    missing = [c for c in header if c not in table[0]]
    if missing:
        raise ValueError(f"the answer lacks {', '.join(missing)}")
    at = [table[0].index(c) for c in header]
    return [[None if row[i] is None else str(row[i]) for i in at] for row in table[1:]]


class Page(InputPartition):
    pass


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.header = json.loads(options["urls"]), json.loads(options["header"])
        self.how = {"tries": int(options.get("tries", TRIES)), "wait": float(options.get("wait", WAIT)), "timeout": float(options.get("timeout", TIMEOUT))}

    def partitions(self) -> list[Page]:
        return [Page(u) for u in self.urls] or [Page("")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.value:
            rows = rows_of(fetch(partition.value, **self.how), self.header)
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(self.header))]
            yield pa.RecordBatch.from_arrays([pa.array([partition.value] * len(rows), pa.string()), *columns], names=["url", *self.header])


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_answers"

    def schema(self) -> str:
        return "url string, " + ", ".join(f"`{c}` string" for c in json.loads(self.options["header"]))

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_pages(spark: SparkSession, urls: Sequence[str], types: Mapping[str, str], *, missing: Sequence[str] = (), **how) -> DataFrame:
    """(url and the columns of ``types``, by name and type) of the rows behind the URLs, one task a page. A text among
    ``missing`` (codes for no answer, say) or of no such type is null. ``how``: tries, wait and timeout of `fetch`."""
    spark.dataSource.register(PagedSource)
    raw = spark.read.format("paged_answers").option("urls", json.dumps(list(urls))).option("header", json.dumps(list(types))).options(**{k: str(v) for k, v in how.items()}).load()
    value = lambda c: F.when(~F.col(f"`{c}`").isin(list(missing)), F.col(f"`{c}`")) if missing else F.col(f"`{c}`")
    return raw.select("url", *[value(c).try_cast(t).alias(c) for c, t in types.items()])
