"""Quality rules over whole texts, with suffix-array repetition as the verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.llm.common import mix, span_hashes, text_blocks, word_spans
from plotline.llm.suffix import maximal_repeats, suffix_array

MIN_REPEAT_WORDS = 10
MAX_COVERED = 0.3
MAX_LONGEST = 300
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def _window_keys(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the word windows inside one document, and a hash of document and window."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    key = mix(doc[at].astype(np.uint64) + np.uint64(7))
    for k in range(size):
        key = mix(key * np.uint64(_ODD[k % 3]) + words[at + k])
    return at, key


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return hit


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0


def repetition(words: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(words covered by maximal repeats of ``least`` words or more, longest repeat in words) of each document."""
    at, key = _window_keys(words, doc, least)
    some = np.zeros(n_docs, bool)
    some[doc[at[_twice(key)]]] = True  # only these documents have a repeat of that length
    covered, longest = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    pick = some[doc] if len(doc) else np.zeros(0, bool)
    if not pick.any():
        return covered, longest
    w, d = words[pick], doc[pick]
    w = mix(w + mix(d.astype(np.uint64) + np.uint64(11)))  # words of different documents never match
    ends = np.searchsorted(d, d, "right")
    first = np.searchsorted(d, d, "left") == np.arange(len(d))
    sa, lcp = suffix_array(w, ends, int(np.bincount(d).max()))
    left = np.where(first, np.arange(len(d), dtype=np.uint64), np.concatenate([w[:1], w[:-1]]))
    _, best = maximal_repeats(sa, lcp, left, least)
    hit = best > 0
    covered += np.bincount(d[_cover(len(d), sa[hit], best[hit])], minlength=n_docs)
    np.maximum.at(longest, d[sa[hit]], best[hit])
    return covered, longest


def measure(data: np.ndarray, offs: np.ndarray, least: int = MIN_REPEAT_WORDS) -> dict[str, np.ndarray]:
    """All figures for a block of whole documents (bytes and offsets)."""
    n_docs = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    inside = _cover(len(data), starts, ends - starts)
    n_words = np.bincount(doc, minlength=n_docs)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, offs[1:]]))
    line_doc = np.sort(np.concatenate([np.arange(n_docs), np.searchsorted(offs, breaks, "right") - 1]))
    c = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = c[line_ends] > c[line_starts]
    line_starts, line_ends, line_doc = line_starts[full], line_ends[full], line_doc[full]
    keys = mix(span_hashes(data, line_starts, line_ends) + mix(line_doc.astype(np.uint64) + np.uint64(3)))
    firsts = np.unique(keys, return_index=True)[1]
    at, key = _window_keys(words, doc, 3)
    repeated = _cover(len(words), at[_twice(key)], 3)
    covered, longest = repetition(words, doc, n_docs, least)
    return {
        "n_words": n_words,
        "word_chars": _per_doc(inside & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _per_doc(SYMBOL[data], offs),
        "n_dup_lines": np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[firsts], minlength=n_docs),
        "n_repeat_words": np.bincount(doc[repeated], minlength=n_docs),
        "covered_words": covered,
        "longest_repeat": longest,
    }


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def quality_rules(docs: DataFrame, *, text_col: str = "text", least: int = MIN_REPEAT_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs`` without columns of the names below, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    covered_words, longest_repeat, base_failed and kept.

    Null texts are empty texts; an empty text has no words and fails the base rule. A document that passes it is kept
    unless maximal repeats of ``least`` words or more cover over ``max_covered`` of its words or one is longer than
    ``max_longest`` words. Texts are handled whole, one row at a time in effect: rows, ids and ties play no part.
    """
    mine = {*FIGURES, "base_failed", "kept"}
    given = docs.select([c for c in docs.columns if c == text_col or c not in mine])
    names = list(given.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch.column(names.index(text_col))):
                figures = measure(data, offs, least)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *[pa.array(figures[f].astype(np.int64)) for f in FIGURES]], names=[*names, *FIGURES])

    schema = T.StructType(list(given.schema))
    for f in FIGURES:
        schema = schema.add(f, "long")
    out = given.mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    fine = (F.col("covered_words") <= F.col("n_words") * F.lit(max_covered)) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op9_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")
