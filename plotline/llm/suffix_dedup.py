"""Exact removal of repeated byte strings with enhanced suffix arrays.

Every ``length``-byte string of a text is assigned to its minimizer: the k-gram inside it with the smallest hash (the
leftmost of equals). Neighbouring strings share theirs, so a text falls into blocks, each a run of strings with one
minimizer. Equal strings have equal minimizers wherever they stand, so blocks meet by the minimizer's hash, a few bytes
each. Equal blocks are one class with a count; in the interval tree they are one leaf that is an interval by itself.
The texts of different classes under one minimizer are fetched and given to an enhanced suffix array: a stack walks the
tree of its common-prefix intervals and keeps those whose suffixes are preceded by different bytes, that is, the maximal
repeats with all their occurrences. What they cover is removed.

A minimizer inside a very common passage may have more classes than one task should hold (HOT). Its strings are then
dealt again, by the place of the minimizer in them (WIDTHS places at a time) and by the bytes that all strings with it at
such places share; fewer places leave more shared bytes, until whole strings are compared. Equal strings stay together
at every step, and each part has its own suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.llm.common import EXACT, _power, keyed, mix, span_hashes, text_blocks, word_spans, write_table
from plotline.llm.suffix import maximal_repeats, suffix_array

LENGTH = 400
#: Words in a row that make a shared passage.
WORDS = 51
GRAM = 64
#: Classes under one minimizer that go into one suffix array at most.
HOT = 256
#: Places of a hot minimizer that are dealt together, step by step.
WIDTHS = (42, 6, 1)
#: Bytes of text in one suffix array, which takes about 150 times as much memory, unless one minimizer has more.
CHUNK = 1 << 18
#: Rows in a batch of found runs or of parts.
ROWS = 1 << 12
SECOND = mix(EXACT)
_LOW = np.uint64((1 << 20) - 1)
_PIECE = 1 << 20


def _window_hashes(data: np.ndarray, size: int, table: np.ndarray = EXACT) -> np.ndarray:
    """Hash of each data[i : i + size]."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(len(data), False), out=p[1:])
    n = len(data) - size + 1
    return mix((p[size:] - p[:n]) * _power(n, True))


def _blocks(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start in it, strings, minimizer hash, block hash, minimizer's place in the block) of the blocks
    of up to _PIECE bytes of texts."""
    n = len(data) - length + 1
    gram = min(GRAM, length)
    sizes = np.diff(offs)
    if n <= 0 or not (sizes >= length).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    h = _window_hashes(data, gram)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    wide, step = length - gram + 1, 1
    while step * 2 <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n], low[wide - step : wide - step + n])
    at = (low & _LOW).astype(np.int64)
    edges = np.zeros(len(data) + 2, np.int32)
    fit = sizes >= length
    np.add.at(edges, offs[:-1][fit], 1)
    np.add.at(edges, offs[1:][fit] - length + 1, -1)
    valid = np.cumsum(edges)[:n] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(new)
    doc = np.searchsorted(offs, lo, "right") - 1
    last = np.concatenate([lo[1:], [n]])
    last = np.minimum(last, offs[doc + 1] - length + 1)
    return doc, lo - offs[doc], last - lo, h[at[lo]], span_hashes(data, lo, last - 1 + length, SECOND), at[lo] - lo


def blocks_of(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    if len(data) <= _PIECE:
        yield _blocks(data, offs, length)
        return
    # one long text: overlapping pieces hold every string once
    step = _PIECE - length + 1
    for at in range(0, max(1, len(data) - length + 1), step):
        piece = data[at : at + _PIECE]
        doc, lo, *rest = _blocks(piece, np.array([0, len(piece)]), length)
        yield doc, lo + at, *rest


def _find_blocks(rows: DataFrame, length: int) -> DataFrame:
    """(rid, lo, n, mh, bh, at) from (_rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, data, offs in text_blocks(b.column(1)):
                for doc, lo, n, m, h, at in blocks_of(data, offs, length):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + first)), pa.array(lo), pa.array(n), pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), pa.array(at)], names=["rid", "lo", "n", "mh", "bh", "at"])

    return rows.select("_rid", "text").mapInArrow(run, "rid long, lo long, n long, mh long, bh long, at long")


def _small(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to BLOCK_BYTES of column ``text``, or of one row: what is made of a slice is let go
    before the next one."""
    for b in batches:
        for lo, hi, *_ in text_blocks(b.column(text)):
            yield b.slice(lo, hi - lo)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def repeats_in(texts: list[bytes], length: int) -> tuple[Iterator[tuple[int, list[tuple[int, int]]]], np.ndarray, np.ndarray]:
    """(maximal repeats, data positions covered, offsets) of the texts; a repeat is (length, [(text, start), ...]). Repeats
    of near copies lie in each other, with many times as many occurrences as there are bytes: they are made one by one."""
    data, offs = _flat(texts)
    ends = np.repeat(offs[1:], np.diff(offs))
    packed = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    pos = np.arange(len(data))
    for k in range(8):
        packed = (packed << np.uint64(8)) | np.where(pos + k < ends, padded[k : k + len(data)], 0).astype(np.uint64)
    longest = int(np.diff(offs).max(initial=1))
    sa, lcp = suffix_array(data, ends, longest, 8, packed)
    left = np.concatenate([[0], data[:-1]]).astype(np.int64)
    left[offs[:-1][np.diff(offs) > 0]] = 256 + np.arange((np.diff(offs) > 0).sum())
    spans, best = maximal_repeats(sa, lcp, left, length)
    hit = best > 0
    edges = np.zeros(len(data) + 1, np.int64)
    np.add.at(edges, sa[hit], 1)
    np.add.at(edges, sa[hit] + best[hit], -1)
    owner = np.repeat(np.arange(len(texts)), np.diff(offs))
    groups = ((n, [(int(owner[p]), int(p - offs[owner[p]])) for p in sa[lo : hi + 1]]) for lo, hi, n in spans)
    return groups, np.cumsum(edges[:-1]) > 0, offs


def _covered_runs(covered: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the covered runs, cut where texts meet."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offs[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(covered))])
    cuts = cuts[covered[cuts] & covered[cuts - 1]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    text = np.searchsorted(offs, starts, "right") - 1
    return text, starts - offs[text], ends - offs[text]


def _text_hash(text: bytes) -> int:
    return int.from_bytes(sha256(text).digest()[:8], "little", signed=True)


def _suffix_runs(batches: Iterator[pa.RecordBatch], length: int, groups: bool) -> Iterator[pa.RecordBatch]:
    """Rows (mh, bh, text, twice) sorted by mh -> covered runs (mh, bh, start, end, repeat null), or with ``groups`` each
    occurrence of each maximal repeat, ``repeat`` being the string's hash. A class with several copies (twice) is a
    repeat as a whole."""
    held: list[tuple[int, int, bytes, bool]] = []

    def runs_of(rows: list[tuple[int, int, bytes, bool]]) -> Iterator[tuple[int, int, int, int, int | None]]:
        data, offs = _flat([r[2] for r in rows])
        h = _window_hashes(data, length)
        owner = np.searchsorted(offs, np.arange(len(h)), "right") - 1
        inside = np.arange(len(h)) + length <= offs[owner + 1]
        h, owner = h[inside], owner[inside]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        some = np.zeros(len(rows), bool)  # blocks without a string that occurs twice need no suffix array
        some[owner[order[1:][same]]] = some[owner[order[:-1][same]]] = True
        yield from ((mh, bh, 0, len(t), _text_hash(t) if groups else None) for mh, bh, t, twice in rows if twice)
        rows = [rows[i] for i in np.flatnonzero(some)]
        if rows:
            found, covered, offs = repeats_in([r[2] for r in rows], length)
            if groups:
                for n, places in found:
                    i, s = places[0]
                    key = _text_hash(rows[i][2][s : s + n])
                    yield from ((rows[i][0], rows[i][1], s, s + n, key) for i, s in places)
            else:
                runs = zip(*(x.tolist() for x in _covered_runs(covered, offs)))
                yield from ((rows[i][0], rows[i][1], s, e, None) for i, s, e in runs if not rows[i][3])

    def work(rows: list[tuple[int, int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
        for out in batched(runs_of(rows), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["mh", "bh", "start", "end", "repeat"])

    size = 0
    for b in _small(batches, 2):
        for row in zip(*(b.column(k).to_pylist() for k in range(4))):
            if size >= CHUNK and held[-1][0] != row[0]:
                yield from work(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield from work(held)


def _suffix_arrays(texts: DataFrame, length: int, groups: bool) -> DataFrame:
    sorted_ = texts.select("mh", "bh", "text", "twice").repartition("mh").sortWithinPartitions("mh")
    return sorted_.mapInArrow(lambda it: _suffix_runs(it, length, groups), "mh long, bh long, start long, end long, repeat long")


def _parts(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    def of(b: pa.RecordBatch) -> Iterator[tuple]:
        for mh, bh, at, text, twice in zip(*(b.column(k).to_pylist() for k in range(5))):
            strings = len(text) - length + 1
            for r in range(max(0, at - strings + 1) // width, at // width + 1):
                near, far = r * width, r * width + width - 1  # places of the minimizer, counted from the string's start
                lo, hi = max(0, at - far), min(strings - 1, at - near)
                part, core = text[lo : hi + length], text[at - near : max(at - near, at - far + length)]
                yield mh, bh, lo, _text_hash(b"%d %d %d " % (mh, width, r) + core), _text_hash(part), at - lo, part, twice

    names = ("mh", "bh", "shift", "mh2", "bh2", "at", "text", "twice")
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
    for b in _small(batches, 3):
        for rows in batched(of(b), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)


def _split(texts: DataFrame, length: int, width: int) -> DataFrame:
    """The classes (mh, bh, at, text, twice) in parts (mh, bh, shift, mh2, bh2, at2, text, twice): of the strings with the
    minimizer at ``width`` neighbouring places, ``mh2`` hashing what they share."""
    kinds = "mh long, bh long, shift long, mh2 long, bh2 long, at long, text binary, twice boolean"
    return texts.select("mh", "bh", "at", "text", "twice").mapInArrow(lambda it: _parts(it, length, width), kinds)


def _split_runs(hot: DataFrame, length: int, groups: bool, step: int = 0) -> DataFrame:
    """Covered runs of the classes under hot minimizers, found in parts of their strings. Without ``groups`` a class
    has one run at most, so that its copies are not joined to every part's: all its strings hold one minimizer, so its
    text is shorter than two strings and its parts' runs overlap."""
    parts = write_table(_split(hot, length, WIDTHS[step]), "suffix-parts")
    classes = parts.groupBy("mh2", "bh2").agg(F.any_value("at").alias("at"), F.any_value("text").alias("text"), (F.max("twice") | (F.count(F.lit(1)) > 1)).alias("twice"))
    classes = write_table(classes.withColumnsRenamed({"mh2": "mh", "bh2": "bh"}), "suffix-part-classes")
    kinds = write_table(classes.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("some")).where("kinds > 1 or some"), "suffix-part-kinds")
    both = classes.join(kinds.select("mh", (F.col("kinds") > HOT).alias("hot")), "mh")
    runs = _suffix_arrays(both.where("not hot"), length, groups)
    if not kinds.where(F.col("kinds") > HOT).isEmpty():  # never at width 1, where a part's classes are equal
        runs = runs.unionByName(_split_runs(both.where("hot").drop("hot"), length, groups, step + 1))
    back = parts.select("mh", "bh", "shift", "mh2", "bh2")
    runs = runs.withColumnsRenamed({"mh": "mh2", "bh": "bh2"}).join(back, ["mh2", "bh2"])
    runs = runs.select("mh", "bh", (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"), "repeat")
    return runs if groups else runs.groupBy("mh", "bh").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.any_value("repeat").alias("repeat"))


def _occurrences(rows: DataFrame, length: int, groups: bool) -> DataFrame:
    """(rid, start, end, repeat) of repeated strings in (_rid, text)."""
    blocks = write_table(_find_blocks(rows, length), "suffix-all")
    # written, so that the join below has two plain shuffles and a hot minimizer's rows can be split
    often = write_table(blocks.groupBy("mh").count().where("count > 1").select("mh"), "suffix-often")
    dup = write_table(blocks.join(often, "mh", "left_semi"), "suffix-blocks")
    classes = dup.groupBy("mh", "bh").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("at").alias("at"), F.min(F.struct("rid", "lo")).alias("one"))
    classes = write_table(classes.select("mh", "bh", "copies", "n", "at", "one.rid", "one.lo"), "suffix-classes")
    several = write_table(classes.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "suffix-several")
    wanted = classes.join(several, "mh").groupBy("rid").agg(F.collect_list(F.struct("mh", "bh", "at", "lo", "n", (F.col("copies") > 1).alias("twice"), (F.col("kinds") > HOT).alias("hot"))).alias("blocks"))
    source = rows.join(wanted.withColumnRenamed("rid", "_rid"), "_rid").select("text", "blocks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, parts in zip(b.column(0), b.column(1)):
                raw, parts = text.as_py().encode("utf-8", "surrogatepass"), parts.as_py()
                texts = pa.array([raw[p["lo"] : p["lo"] + p["n"] - 1 + length] for p in parts], pa.binary())
                ids = [pa.array([p[c] for p in parts], pa.int64()) for c in ("mh", "bh", "at")]
                yield pa.RecordBatch.from_arrays([*ids, texts, *[pa.array([p[c] for p in parts]) for c in ("twice", "hot")]], names=["mh", "bh", "at", "text", "twice", "hot"])

    texts = write_table(source.mapInArrow(cut, "mh long, bh long, at long, text binary, twice boolean, hot boolean"), "suffix-texts")
    runs = _suffix_arrays(texts.where("not hot"), length, groups)
    if not several.where(F.col("kinds") > HOT).isEmpty():
        runs = runs.unionByName(_split_runs(texts.where("hot").drop("hot"), length, groups))
    # a class alone under its minimizer is its own interval tree
    alone = classes.where("copies > 1").join(several, "mh", "left_anti")
    whole = alone.select("mh", "bh", F.lit(0).cast("long").alias("start"), (F.col("n") + (length - 1)).alias("end"), F.col("bh").alias("repeat"))
    found = dup.select("rid", "lo", "mh", "bh").join(runs.unionByName(whole), ["mh", "bh"])
    return found.select("rid", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("end")).alias("end"), "repeat")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "suffix-rows")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(differ[0]) if len(differ) else n


def _islands(found: DataFrame) -> DataFrame:
    """(group, rid, lo, hi): the repeats (rid, start, end, repeat), those of one pattern joined where they overlap. A
    pattern is where a repeat's occurrences are: in which documents and at which distances."""
    found = write_table(found.distinct(), "suffix-found")
    first = found.groupBy("repeat").agg(F.min(F.struct("rid", "start")).alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.col("end") - F.col("start")).alias("length"))
    first = first.select("repeat", F.col("first.rid").alias("in_rid"), F.col("first.start").alias("begin"), "n", "length")
    place = F.xxhash64("rid", F.col("start") - F.col("begin"))
    pattern = found.join(first, "repeat").groupBy("repeat").agg(F.sum(F.pmod(place, F.lit(1 << 40))).alias("p"), F.bit_xor(place).alias("q"))
    by = Window.partitionBy("in_rid", "n", "p", "q").orderBy("begin", "repeat")
    lined = first.join(pattern, "repeat").withColumn("reach", F.max(F.col("begin") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("begin") <= F.col("reach"), 0).otherwise(1)
    lined = lined.withColumn("island", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    heads = lined.groupBy("in_rid", "n", "p", "q", "island").agg(F.min(F.struct("begin", "repeat")).alias("head"), F.max(F.col("begin") + F.col("length")).alias("stop"))
    heads = heads.select(F.col("head.repeat").alias("repeat"), (F.col("stop") - F.col("head.begin")).alias("length"))
    return found.join(heads, "repeat").select(F.col("repeat").alias("group"), "rid", F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi"))


def _stretched(groups: DataFrame, rows: DataFrame, width: int = 1024) -> DataFrame:
    """The groups (group, rid, lo, hi) grown to both sides as far as all occurrences agree, each string once. What stands
    next to an occurrence is looked at ``width`` bytes at a time, then four times as many; the prefix that a group's
    contexts share is that of the smallest and the largest of them."""
    done, growing = None, write_table(groups, "suffix-groups")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, parts in zip(b.column(0), b.column(1)):
                raw, parts = text.as_py().encode("utf-8", "surrogatepass"), parts.as_py()
                before, after = [raw[max(0, p["lo"] - width) : p["lo"]][::-1] for p in parts], [raw[p["hi"] : p["hi"] + width] for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([p["group"] for p in parts], pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["group", "before", "after"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [pa.array([_common(x.as_py(), y.as_py()) for x, y in zip(b.column(i), b.column(i + 1))], pa.int64()) for i in (1, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *sides], names=["group", "left", "right"])

    while True:
        asked = growing.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("group", "lo", "hi")).alias("parts"))
        contexts = rows.join(asked, "_rid").select("text", "parts").mapInArrow(beside, "group long, before binary, after binary")
        ends = contexts.groupBy("group").agg(F.min("before"), F.max("before"), F.min("after"), F.max("after"))
        more = ends.mapInArrow(common, "group long, left long, right long")
        wide = (F.col("left") == width) | (F.col("right") == width)
        grown = write_table(growing.join(more, "group").select("group", "rid", (F.col("lo") - F.col("left")).alias("lo"), (F.col("hi") + F.col("right")).alias("hi"), wide.alias("wide")), "suffix-grown")
        ended = grown.where("not wide").drop("wide")
        done = ended if done is None else done.unionByName(ended)
        growing = grown.where("wide").drop("wide")
        if growing.isEmpty():
            break
        width *= 4
    first = done.groupBy("group").agg(F.min(F.struct("rid", "lo")).alias("first"), F.max(F.col("hi") - F.col("lo")).alias("length"))
    once = first.groupBy("first", "length").agg(F.min("group").alias("group")).select("group")
    return done.join(once, "group")


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Maximal repeat groups with all their occurrences: (repeat, length, doc_id, start), bytes from 0.

    Every repeated string of ``length`` bytes is in a group that reaches as far to both sides as all occurrences agree;
    so is every longer repeat inside a block of up to 737 bytes. (Not listed are repeats that cross blocks while each
    string of ``length`` bytes in them also stands elsewhere.) Repeated rows and ids are documents of their own."""
    rows = _rows(docs, id_col, text_col)
    groups = _stretched(_islands(_occurrences(rows, length, True)), rows).withColumnRenamed("rid", "_rid")
    return groups.join(rows.select("_rid", "doc_id"), "_rid").select(F.col("group").alias("repeat"), (F.col("hi") - F.col("lo")).alias("length"), "doc_id", F.col("lo").alias("start"))


def _marks(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the strings of about half of ``words`` words that have the smallest hash among those inside
    some ``words`` words of a document, so that documents sharing ``words`` words share one of them."""
    gram = words // 2
    starts, ends, doc = word_spans(data, offs)
    n = len(starts) - words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = span_hashes(data, starts, ends)
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power(len(h), False), dtype=np.uint64)])
    g = mix((p[gram:] - p[:-gram]) * _power(len(h) - gram + 1, True))
    wide = words - gram + 1
    low = np.lib.stride_tricks.sliding_window_view(g, wide)[:n].argmin(1) + np.arange(n)
    at = np.unique(low[doc[:n] == doc[words - 1 :]])
    return doc[at], g[at]


def _shared_passages(rows: DataFrame, words: int) -> DataFrame:
    """(_rid, n_shared) of every row of (_rid, text) that shares ``words`` words in a row with another one, and maybe of
    some that share over half of them: how many of its marks stand in another row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, data, offs in text_blocks(b.column(1)):
                doc, h = _marks(data, offs, words)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + first)), pa.array(h.view(np.int64))], names=["_rid", "h"])

    marks = write_table(rows.select("_rid", "text").mapInArrow(run, "_rid long, h long"), "passage-marks")
    # written, so that the join has two plain shuffles and a common passage's rows can be split
    often = write_table(marks.groupBy("h").agg(F.min("_rid").alias("a"), F.max("_rid").alias("b")).where("a <> b").select("h"), "passage-often")
    return marks.join(often, "h").groupBy("_rid").agg(F.count(F.lit(1)).alias("n_shared"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans array<struct<start, end>>, kept (the remaining bytes) and
    text (those bytes as text; halves of characters become U+FFFD), and n_shared, above 0 where the text shares ``words``
    words in a row with another document: such passages may be too short for a removal by bytes.

    A byte is removed if a ``length``-byte string that covers it starts anywhere else too, in this document or another;
    all copies go. Null texts are empty; texts under ``length`` bytes are left alone. Repeated rows and ids are
    documents of their own (and so copies of each other). Extra columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    found = _occurrences(rows, length, False)
    spans = found.groupBy(F.col("rid").alias("_rid")).agg(F.collect_set(F.struct("start", "end")).alias("found"))
    told = spans.join(_shared_passages(rows, words), "_rid", "full")
    both = rows.join(told, "_rid", "left").select("doc_id", "text", "found", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 1):
            sizes, gone, runs, kept, texts = [], [], [], [], []
            for text, found in zip(b.column(1), b.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in found.as_py() or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                at, parts = 0, []
                for s, e in merged:
                    parts.append(raw[at:s])
                    at = e
                parts.append(raw[at:])
                sizes.append(len(raw)), gone.append(sum(e - s for s, e in merged)), kept.append(b"".join(parts))
                texts.append(kept[-1].decode("utf-8", "replace"))
                runs.append([{"start": s, "end": e} for s, e in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), b.column(3)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "text", "n_shared"])

    schema = rows.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary").add("text", "string").add("n_shared", "long")
    return both.mapInArrow(cut, schema)


def op1_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text", "n_shared")
