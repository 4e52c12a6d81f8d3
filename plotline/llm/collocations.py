"""Phrase collocation mining: exact phrase counts from burst tries whose subtrees are spilled as sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotline.llm.common import FOLDED, mix, span_hashes, text_blocks, word_spans, write_table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A longer candidate hides a shorter one inside it from this share (percent) of its count on.
COVERED = 100
#: Bits of the bitmap that stands for frequent words or pairs in tasks (8 MB whatever the corpus): a superset, so that
#: it saves work and never decides a count.
BITS = 26
#: The longest phrases that are counted by key first; longer ones are counted where all such parts are frequent.
FILTERS = 3
#: Rows of a container before it bursts, bytes of a trie before its largest subtree is spilled.
BURST_ROWS = 1 << 16
TRIE_BYTES = 64 << 20
BLOCK = 1 << 21
#: Words of the corpus for each prefix partition at most, on average.
PART_WORDS = 1 << 22

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPLIT = BREAK.copy()
SPLIT[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Rows:
    """Phrases as columns: key (a 64-bit hash of language and words), path (a nibble for each of the first two words and
    one of the key), count and, where texts are wanted, language number and text."""

    def __init__(self, key: np.ndarray, path: np.ndarray, count: np.ndarray, lang: np.ndarray | None = None, text: pa.Array | None = None):
        self.key, self.path, self.count, self.lang, self.text = key, path, count, lang, text

    def __len__(self) -> int:
        return len(self.key)

    @property
    def size(self) -> int:
        return 24 * len(self.key) + (self.text.nbytes if self.text is not None else 0)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.key[at], self.path[at], self.count[at], None if self.lang is None else self.lang[at], None if self.text is None else self.text.take(pa.array(at)))


def merged(runs: list[Rows]) -> Rows:
    """One run sorted by key with the counts of equal keys added up."""
    if len(runs) == 1:
        return runs[0]
    texts = runs[0].text is not None
    every = Rows(*(np.concatenate([getattr(r, c) for r in runs]) for c in ("key", "path", "count")))
    if texts:
        every.lang, every.text = np.concatenate([r.lang for r in runs]), pa.concat_arrays([r.text for r in runs])
    order = np.argsort(every.key, kind="stable")
    key = every.key[order]
    firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out = every.take(order[firsts])
    if len(firsts):
        out.count = np.add.reduceat(every.count[order], firsts)
    return out


class Container:
    """A leaf of the trie: runs of phrases, merged when they pile up."""

    def __init__(self) -> None:
        self.runs: list[Rows] = []
        self.rows = self.size = 0

    def add(self, rows: Rows) -> None:
        self.runs.append(rows)
        self.rows += len(rows)
        self.size += rows.size

    def compact(self) -> Rows | None:
        if not self.runs:
            return None
        self.runs = [merged(self.runs)]
        self.rows, self.size = len(self.runs[0]), self.runs[0].size
        return self.runs[0]


class Trie:
    """A trie of depth three at most, 16 children a node, chosen by the id of the first word, of the second word and by
    the key; its leaves are containers that burst into a node once they hold too many different phrases."""

    def __init__(self, depth: int = 0) -> None:
        self.depth = depth
        self.children: list[Container | Trie] = [Container() for _ in range(16)]

    @property
    def size(self) -> int:
        return sum(c.size for c in self.children)

    def add(self, rows: Rows) -> None:
        child = (rows.path >> np.uint16(4 * (2 - self.depth))) & np.uint16(15)
        order = np.argsort(child, kind="stable")
        cuts = np.searchsorted(child[order], np.arange(17))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            # a slice of a run sorted by key stays sorted
            self._put(k, rows.take(order[cuts[k] : cuts[k + 1]]))

    def _put(self, k: int, rows: Rows) -> None:
        leaf = self.children[k]
        leaf.add(rows)
        if isinstance(leaf, Container) and leaf.rows > BURST_ROWS:
            whole = leaf.compact()
            if self.depth < 2 and leaf.rows > BURST_ROWS // 2:
                self.children[k] = node = Trie(self.depth + 1)
                node.add(whole)

    def runs(self) -> Iterator[Rows]:
        """All phrases below, a sorted run for each container, in the trie's order."""
        for c in self.children:
            if isinstance(c, Trie):
                yield from c.runs()
            elif (run := c.compact()) is not None:
                yield run

    def spill(self) -> Iterator[Rows]:
        """The runs of the largest subtree below the root, which is empty afterwards."""
        k = max(range(16), key=lambda i: self.children[i].size)
        subtree = self.children[k]
        self.children[k] = Container()
        yield from subtree.runs() if isinstance(subtree, Trie) else [subtree.compact()]


class Words:
    """The words of a block of whole documents, and the keys of the phrases that begin at each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, seeds: np.ndarray):
        self.data = data
        self.starts, self.ends, self.doc = word_spans(data, offs, SPLIT)
        self.word = span_hashes(data, self.starts, self.ends, FOLDED)
        breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
        n = len(self.word)
        self.joined = np.zeros(n, bool)  # with the word before
        if n:
            self.joined[1:] = (self.doc[1:] == self.doc[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])
        self.keys = [mix(self.word + seeds[self.doc])]

    def key(self, m: int) -> np.ndarray:
        """Of the m words from each position on; there are m - 1 fewer positions than words."""
        while len(self.keys) < m:
            have = self.keys[-1]
            size = max(0, len(have) - 1)
            self.keys.append(mix(have[:size] * _ODD + self.word[len(self.keys) :]))
        return self.keys[m - 1]

    def together(self, flags: np.ndarray, m: int) -> np.ndarray:
        """At which of ``flags``'s positions m flags in a row are set."""
        size = max(0, len(flags) - m + 1)
        out = flags[:size].copy()
        for i in range(1, m):
            out &= flags[i : size + i]
        return out

    def path(self, at: np.ndarray, m: int, key: np.ndarray) -> np.ndarray:
        second = self.word[at + 1] if m > 1 else key >> np.uint64(8)
        return (((self.word[at] & np.uint64(15)) << np.uint64(8)) | ((second & np.uint64(15)) << np.uint64(4)) | (key & np.uint64(15))).astype(np.uint16)

    def texts(self, at: np.ndarray, m: int) -> pa.Array:
        """The phrases of m words at the positions, A-Z lower-cased, one space between words."""
        word = (at[:, None] + np.arange(m)).ravel()
        length = self.ends[word] - self.starts[word]
        length[np.arange(len(word)) % m != m - 1] += 1  # a space
        to = np.concatenate([[0], np.cumsum(length)])
        within = np.arange(to[-1]) - np.repeat(to[:-1], length)
        source = np.minimum(np.repeat(self.starts[word], length) + within, len(self.data) - 1)
        out = LOWER[self.data[source]]
        out[np.repeat(self.ends[word] - self.starts[word], length) == within] = 0x20
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(to[::m].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


def _bit(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key >> np.uint64(64 - BITS)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each possible beginning of a key, set where ``key`` has one; 2 ** (BITS - 6) numbers at most reach the driver."""
    slots = keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("slot"))
    rows = slots.groupBy(F.shiftrightunsigned("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _sorted_runs(rows: Rows, spread: int, langs: pa.Array | None) -> pa.RecordBatch:
    """A row for each prefix partition (the path and ``spread`` more bits of the key): its phrases as one sorted run."""
    part = (rows.path.astype(np.int64) << spread) | ((rows.key >> np.uint64(4)) & np.uint64((1 << spread) - 1)).astype(np.int64)
    order = np.lexsort((rows.key, part))
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0, [True]])) if len(rows) else np.zeros(1, np.int64)
    whole = rows.take(order)
    packed = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
    offsets = pa.array(cuts.astype(np.int32))
    some = langs is not None
    return pa.RecordBatch.from_arrays(
        [pa.array(part[order][cuts[:-1]]), packed(whole.key), packed(whole.count),
         pa.ListArray.from_arrays(offsets, langs.take(pa.array(whole.lang))) if some else pa.nulls(len(cuts) - 1, pa.list_(pa.string())), pa.ListArray.from_arrays(offsets, whole.text) if some else pa.nulls(len(cuts) - 1, pa.list_(pa.string()))],
        names=["part", "key", "a", "lang", "text"],
    )


RUN = "part long, key binary, a binary, lang array<string>, text array<string>"
#: The partition that holds the words of each lang.
TOTALS = -1


def _merged(runs: list[dict], texts: bool, least: int) -> pa.RecordBatch:
    """The phrases of one prefix partition that reach ``least`` over all its runs."""
    count = np.concatenate([np.frombuffer(r["a"], np.int64) for r in runs])
    if runs[0]["part"] == TOTALS or texts:
        flat = [pa.concat_arrays([r[c].values for r in runs]) for c in ("lang", "text")]
        t = pa.table({"lang": flat[0], "phrase": flat[1], "a": count}).group_by(["lang", "phrase"]).aggregate([("a", "sum")])
        t = t.filter(pc.greater_equal(t.column("a_sum"), least)) if runs[0]["part"] != TOTALS else t
        lang, phrase, a = (t.column(c).combine_chunks() for c in ("lang", "phrase", "a_sum"))
        key = pa.nulls(len(a), pa.int64())
    else:
        key = np.concatenate([np.frombuffer(r["key"], np.uint64) for r in runs])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(count, first)
        enough = total >= least
        lang, phrase, key, a = pa.nulls(int(enough.sum()), pa.string()), pa.nulls(int(enough.sum()), pa.string()), pa.array(key[first][enough].view(np.int64)), pa.array(total[enough])
    return pa.RecordBatch.from_arrays([lang, phrase, key, a], names=["lang", "phrase", "key", "a"])


def _count(docs: DataFrame, pick: Callable[[Words], Iterator[tuple[int, np.ndarray]]], least: int, *, texts: bool, totals: bool = False, spread: int = 0) -> DataFrame:
    """(lang, phrase, key, a) of the phrases that ``pick`` names (number of words, positions) and that occur ``least`` times:
    lang and phrase with ``texts``, else the key. With ``totals`` a row without phrase and key for each lang has its words.

    Each task fills a trie and spills its subtrees as sorted runs, one for each prefix partition; Spark deals the partitions
    out, and a task merges the runs of one after the other. A partition is a prefix and some bits of the key, so that a
    common first word fills many of them."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        seeds = np.zeros(0, np.uint64)
        words = np.zeros(0, np.int64)
        trie = Trie()

        def out(found: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(langs), pa.string()) if texts else None
            for rows in found:
                if len(rows):
                    yield _sorted_runs(rows, spread, names)

        for batch in batches:
            coded = pc.dictionary_encode(batch.column(0))
            for name in coded.dictionary.to_pylist():
                if name not in langs:
                    langs[name] = len(langs)
                    raw = np.frombuffer(name.encode(), np.uint8)
                    seeds = np.append(seeds, mix(span_hashes(raw, np.array([0]), np.array([len(raw)]))))
                    words = np.append(words, 0)
            of = np.array([langs[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.int64)
            for lo, hi, data, offs in text_blocks(batch.column(1), BLOCK):
                w = Words(data, offs, seeds[of[lo:hi]])
                words += np.bincount(of[lo:hi][w.doc], minlength=len(words))
                for m, at in pick(w):
                    key, first, count = np.unique(w.key(m)[at], return_index=True, return_counts=True)
                    if len(key):
                        at = at[first]
                        trie.add(Rows(key, w.path(at, m, key), count, *((of[lo:hi][w.doc[at]], w.texts(at, m)) if texts else ())))
                while trie.size > TRIE_BYTES:
                    yield from out(trie.spill())
        yield from out(trie.runs())
        if totals and langs:
            one = pa.array([0, len(langs)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([TOTALS]), pa.array([b""], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.ListArray.from_arrays(one, pa.array(list(langs))), pa.ListArray.from_arrays(one, pa.nulls(len(langs), pa.string()))],
                names=["part", "key", "a", "lang", "text"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if runs and runs[0]["part"] != part:
                    yield _merged(runs, texts, least)
                    runs = []
                runs.append({"part": part, "key": batch.column(1)[i].as_buffer(), "a": batch.column(2)[i].as_buffer(), "lang": batch.column(3)[i], "text": batch.column(4)[i]})
        if runs:
            yield _merged(runs, texts, least)

    return docs.mapInArrow(fill, RUN).repartition("part").sortWithinPartitions("part").mapInArrow(merge, "lang string, phrase string, key long, a long")


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, size) of all phrases of up to ``max_words`` words that occur ``min_count`` times or more in their
    lang, and (lang, n) with the words of each lang.

    A phrase can be no more frequent than its parts: after the words, pairs of frequent words and triples of frequent pairs
    are counted by their keys, each pass over the texts leaving a bitmap; a last one counts the texts of all phrases whose
    parts have their bits, exactly."""
    spark: SparkSession = docs.sparkSession
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = write_table(_count(given, lambda w: iter([(1, np.arange(len(w.word)))]), min_count, texts=False, totals=True), "words")
    n = words.where(F.col("key").isNull()).select("lang", F.col("a").alias("n"))
    every = n.agg(F.sum("n")).first()[0] or 1
    # about PART_WORDS words at most for each of the 4096 prefixes and a share of their keys
    spread = max(0, (every // (PART_WORDS << 12)).bit_length())
    bitmaps = [spark.sparkContext.broadcast(_bitmap(words.where(F.col("key").isNotNull())))]

    def likely(w: Words) -> Iterator[tuple[int, np.ndarray]]:
        """By size, where phrases begin all of whose parts have a bit; beyond the bitmaps' sizes, all of the largest of them."""
        flags = np.ones(len(w.word), bool)
        for m in range(1, max_words + 1):
            if m > len(w.word):
                return
            flags = w.together(flags, 2) if m > 1 else flags
            if m == 2:
                flags &= w.joined[1:]
            if m <= len(bitmaps):
                flags &= _bit(bitmaps[m - 1].value, w.key(m))
            yield m, np.flatnonzero(flags)

    for m in range(2, min(FILTERS, max_words - 1) + 1):
        counted = _count(given, lambda w, m=m: ((k, at) for k, at in likely(w) if k == m), min_count, texts=False, spread=spread)
        bitmaps.append(spark.sparkContext.broadcast(_bitmap(counted)))
    out = _count(given, likely, min_count, texts=True, spread=spread).select("lang", "phrase", "a", F.size(F.split("phrase", " ")).alias("size"))
    return write_table(out, "phrases"), n


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``; a null
    text is empty, a null lang is ``und``. a, l and r count a phrase and the two parts of its lowest-scoring cut (at a tie
    the earliest) in pieces of the lang, overlaps included, n all its words; score is floor(1000 a n / (l r)). Phrases with
    fewer than ``min_count`` occurrences are no candidates; a candidate inside a longer one that has ``covered`` percent of
    its occurrences or more is dropped. Order: score and a falling, then the phrase's bytes. All counts are exact and all
    arithmetic is decimal. Repeated rows count as often as they stand there; an empty table gives no rows; other columns
    play no part. One text is handled whole in one task."""
    counts, n = phrase_counts(docs, text_col=text_col, lang_col=lang_col, min_count=min_count, max_words=max_words)
    candidates = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    cut = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("first"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("rest"))
    part = counts.select("lang", "phrase", "a")
    cut = cut.join(part.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(n, "lang")
    exact = {c: f"cast({c} as decimal(19,0))" for c in "alrn"}
    score = F.expr(f"cast(1000 * {exact['a']} as decimal(22,0)) * cast({exact['n']} as decimal(16,0)) div ({exact['l']} * {exact['r']})")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # every shorter phrase of two words or more inside a longer candidate
    inner = candidates.where("size > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("m"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    out = left.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_hat_trie_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
