"""Near-duplicate classes by b-bit MinHash.

Every document gets HASHES minima of its shingle hashes. Bands of ROWS minima make candidate buckets; of all minima only
the lowest two bits are kept, packed, and the similarity of a candidate pair is estimated from the count of equal pairs
of bits, corrected for chance agreement. Pairs whose estimate is not hopeless are confirmed on their full shingle sets.

Documents with the same shingle set form one class, and only class representatives are compared. Buckets are never
expanded into all pairs: each member first meets one leader per bucket; then only members of one bucket that are still in
different components meet, nearest estimates first, until no such pair is untested. No pair that shares a bucket and passes
the estimate is lost unless its two documents are connected already. With 28 bands of 4 a pair at similarity 0.8 shares no
bucket with probability 4e-7; the estimate lets it fail with 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotline.llm.common import FOLDED, keyed, mix, span_hashes, text_blocks, word_spans, write_table

BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
BITS = 2
LANES = 28  # two-bit lanes in each of the signature's four longs
#: An estimate this far below the threshold (5 standard errors) rules a pair out.
SLACK = 0.225
BLOCK = 2048
#: Untested partners that a document meets in each further round; the last round has no limit.
MEETINGS = (2, None)

_rng = np.random.Generator(np.random.PCG64(77))
_FLIP = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SPREAD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct hashes of ``size``-word shingles, document after document, and how many each has.
    A document with fewer words has its whole sequence as one shingle; one without words has none."""
    n_docs = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    words = span_hashes(data, starts, ends, FOLDED)
    n = np.bincount(doc, minlength=n_docs)
    firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
    at = np.flatnonzero(doc[: max(0, len(doc) - size + 1)] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = mix(h * _ODD + words[at + k])
    owner = doc[at]
    for length in range(1, size):
        short = np.flatnonzero(n == length)
        g = np.full(len(short), length, np.uint64)
        for k in range(length):
            g = mix(g * _ODD + words[firsts[short] + k])
        h, owner = np.concatenate([h, g]), np.concatenate([owner, short])
    order = np.argsort(h)
    kind = np.uint16 if n_docs < 65536 else np.int64
    order = order[np.argsort(owner[order].astype(kind), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n_docs)


def signatures(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two hashes of the whole set, band keys, packed low bits) of each document with shingles."""
    starts = np.concatenate([[0], np.cumsum(counts[counts > 0])[:-1]]).astype(np.int64)
    whole = np.stack([np.add.reduceat(mix(h + np.uint64(c)), starts) for c in (1, 2)])
    minima = np.empty((HASHES, len(starts)), np.uint64)
    scratch = np.empty_like(h)
    for k in range(HASHES):
        np.bitwise_xor(h, _FLIP[k], out=scratch)
        np.multiply(scratch, _SPREAD[k], out=scratch)
        minima[k] = np.minimum.reduceat(scratch, starts)
    bands = np.empty((BANDS, len(starts)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * _ODD + minima[b * ROWS + r])
        bands[b] = key
    low = (minima >> np.uint64(20)) & np.uint64(3)
    packed = np.zeros((HASHES // LANES, len(starts)), np.uint64)
    for k in range(HASHES):
        packed[k // LANES] |= low[k] << np.uint64(2 * (k % LANES))
    return whole, bands, packed


def corrected(matches: Column) -> Column:
    """Similarity from the number of equal lanes, without those equal by chance."""
    chance = 1.0 / (1 << BITS)
    return (matches / HASHES - chance) / (1 - chance)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures (arrays of four longs) by bit counts."""
    differ = F.lit(0)
    for w in range(HASHES // LANES):
        x = a[w].bitwiseXOR(b[w])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return corrected(F.lit(HASHES) - differ)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node of an edge.

    In a round every node a hooks its smaller neighbours to the smallest of them, and its own pointer to that one skips
    to where that one points. Edges never grow in number; each round is written to the shared folder, and the last one
    changes nothing."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        hooks = edges.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"), F.lit(True).alias("changed"))
        skips = low.join(low.select(F.col("a").alias("low"), F.col("low").alias("next")), "low", "left").select("a", F.coalesce("next", "low").alias("b"), F.col("next").isNotNull().alias("changed"))
        done = write_table(hooks.unionByName(skips), "cc")
        edges = done.select("a", "b")
        if done.where("changed").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(_rid, other columns, shingles array<long>) from (_rid, text, other columns)."""
    names = [c for c in texts.columns if c != "text"]
    at = texts.columns.index("text")
    others = [i for i in range(len(texts.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(at)):
                h, counts = shingle_sets(data, offs, size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(h.view(np.int64)))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in others], lists], names=[*names, "shingles"])

    return texts.mapInArrow(run, texts.select(names).schema.add("shingles", T.ArrayType(T.LongType())))


def _prints(texts: DataFrame, size: int) -> DataFrame:
    """(_rid, prints): the lowest 16 bits of a document's shingle hashes, sorted. Two documents have at least as many
    prints in common (repeats counted) as shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(1)):
                h, counts = shingle_sets(data, offs, size)
                at = np.concatenate([[0], np.cumsum(counts)])
                low = (h & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([np.sort(low[x:y]).tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["_rid", "prints"])

    return texts.select("_rid", "text").mapInArrow(run, "_rid long, prints binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union of their full shingle sets."""
    left = _sets(texts.join(pairs.select(F.col("a").alias("_rid"), "b"), "_rid").select("_rid", "text", "b"), size)
    right = _sets(texts.join(pairs.select(F.col("b").alias("_rid")).distinct(), "_rid").select("_rid", "text"), size)
    both = left.select(F.col("_rid").alias("a"), "b", F.col("shingles").alias("x")).join(right.select(F.col("_rid").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total")).where(F.col("common") * 100 >= (F.col("total") - F.col("common")) * threshold).select("a", "b")


def _meet(shared: DataFrame, labels: DataFrame, sigs: DataFrame, bar: float, threshold: int, most: int | None) -> DataFrame:
    """Pairs (a, b), a > b, of one bucket but different components that pass both filters of _compare; with ``most``,
    each document's best ones. Large buckets are cut into blocks, and a task compares two blocks."""
    rows = shared.join(labels, shared["rid"] == labels["node"], "left").select("key", "rid", F.coalesce("component", "rid").alias("label"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi")
    rows = rows.join(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rid", "key"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "rid", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid", "label")
    rows = rows.join(sigs.select(F.col("_rid").alias("rid"), "sig", "prints"), "rid").select("key", "i", "j", "own", "rid", "label", "sig", "prints")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lambda it: _compare(it, bar, threshold, most), "a long, b long").distinct()


def _tokens(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of all prints; the k-th repeat of a print in a row is a token of its own."""
    sizes = np.array([len(x) // 2 for x in prints])
    row = np.repeat(np.arange(len(prints)), sizes)
    v = np.frombuffer(b"".join(prints), np.uint16).astype(np.int64)
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    return row, v + ((np.arange(len(v)) - first) << 16)


def common_prints(prints: list[bytes], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Prints that rows p[k] and q[k] have in common. Many pairs are counted by matrix products over the prints that
    two rows or more hold, a few columns at a time; few pairs one by one."""
    if len(p) < 64:
        cut = [_tokens([x])[1] for x in prints]
        return np.array([len(np.intersect1d(cut[x], cut[y], assume_unique=True)) for x, y in zip(p.tolist(), q.tolist())], np.int64)
    row, token = _tokens(prints)
    _, column, held = np.unique(token, return_inverse=True, return_counts=True)
    often = held > 1
    column, row = (np.cumsum(often) - 1)[column][often[column]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(prints), len(prints)), np.float32)
    for at in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        m = np.zeros((len(prints), 2048), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    return both[p, q].astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch], bar: float, threshold: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of each run of rows (key, i, j, own, rid, label, sig, prints) with equal key, i and j, two blocks at most.

    Runs are gathered to thousands of rows; signatures are compared at growing distance, all runs at once. Pairs
    whose estimate reaches ``bar`` must also have enough prints in common for the threshold, which never rules out a
    real link; so few pairs that are none leave the task."""
    held: list[list] = []

    def columns(b: pa.RecordBatch) -> list:
        sig = np.array(b.column(6).flatten()).view(np.uint64).reshape(b.num_rows, -1)
        return [*[np.array(b.column(k)) for k in range(6)], sig, np.array([*b.column(7).to_pylist(), None], object)[:-1]]

    def work(parts: list) -> Iterator[pa.RecordBatch]:
        key, i, j, own, rid, label, sig, prints = parts
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        run = np.cumsum(new)
        left, right = [], []
        for d in range(1, int(np.bincount(run).max(initial=0))):
            at = np.flatnonzero(run[d:] == run[:-d])
            at = at[(label[at] != label[at + d]) & ((i[at] == j[at]) | (own[at] != own[at + d]))]
            differ = np.zeros(len(at), np.int64)
            for w in range(sig.shape[1]):
                x = sig[at, w] ^ sig[at + d, w]
                differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
            at = at[((HASHES - differ) / HASHES - 0.25) / 0.75 >= bar]
            at = at.astype(np.int32)
            left.append(at), right.append(at + np.int32(d))
        if not left:
            return
        p, q = np.concatenate(left), np.concatenate(right)
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        sizes = np.array([len(x) // 2 for x in prints])
        keep, score = np.zeros(len(p), bool), np.zeros(len(p))
        edges = np.flatnonzero(np.concatenate([[True], run[p[1:]] != run[p[:-1]], [True]])) if len(p) else np.zeros(0, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows, at = np.unique(np.concatenate([p[lo:hi], q[lo:hi]]), return_inverse=True)
            common = common_prints([prints[r] for r in rows], at[: hi - lo], at[hi - lo :])
            total = sizes[p[lo:hi]] + sizes[q[lo:hi]]
            keep[lo:hi], score[lo:hi] = common * 100 >= (total - common) * threshold, common / np.maximum(total - common, 1)
        p, q, score = p[keep], q[keep], score[keep]
        if most is not None:  # each document of a run keeps its best partners
            keep = np.zeros(len(p), bool)
            for end in (p, q):
                order = np.lexsort((-score, end))
                first = np.searchsorted(end[order], end[order], "left")
                keep[order] |= np.arange(len(order)) - first < most
            p, q = p[keep], q[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rid[p], rid[q])), pa.array(np.minimum(rid[p], rid[q]))], names=["a", "b"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c = columns(batch)
        if size >= 6_000:
            # whole runs only: what belongs to the last run waits for the rest of it
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]) | (whole[2][1:] != whole[2][:-1]))
            if len(cut):
                yield from work([x[: cut[-1] + 1] for x in whole])
                whole = [x[cut[-1] + 1 :] for x in whole]
            held, size = [whole], len(whole[0])
        held.append(c)
        size += batch.num_rows
    if held:
        yield from work([np.concatenate(x) for x in zip(*held)])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: _rid, doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= threshold * union of their sets of ``size``-word shingles (A-Z
    lower-cased). component_id is the smallest doc_id reachable over links, the document itself included; kept marks
    one document of each component: that of the smallest id. Null and wordless texts are linked with nothing. Repeated
    ids and null ids are documents of their own; of rows that share the smallest id one is kept. An empty table gives
    no rows; extra columns are ignored.
    """
    return _near(keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "near-rows"), size, threshold)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each component."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = keyed(rows, "doc_id", "near-rows")
    kept = _near(rows.select("_rid", "doc_id", "text"), size, threshold).where("kept").select("_rid")
    return rows.select("_rid", "row").join(kept, "_rid", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _near(rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """near_duplicates of (_rid, doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_blocks(b.column(2)):
                h, counts = shingle_sets(data, offs, size)
                some = np.flatnonzero(counts)
                n = hi - lo
                whole, bands, packed = np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros((n, HASHES // LANES), np.uint64)
                if len(some):
                    w, k, p = signatures(h, counts)
                    whole[:, some], bands[some], packed[some] = w, k.T, p.T
                part = b.slice(lo, n)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1).view(np.int64))) for m in (bands, packed)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts.astype(np.int64)), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), *lists], names=["_rid", "doc_id", "n", "s1", "s2", "bands", "sig"])

    schema = rows.select("_rid", "doc_id").schema.add("n", "long").add("s1", "long").add("s2", "long").add("bands", T.ArrayType(T.LongType())).add("sig", T.ArrayType(T.LongType()))
    signed = write_table(rows.select("_rid", "doc_id", "text").mapInArrow(sign, schema), "near-signed")
    full = signed.where("n > 0")
    classes = write_table(full.groupBy("n", "s1", "s2").agg(F.min("_rid").alias("rep")), "near-classes")
    member = full.select("_rid", "doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("_rid", "doc_id", "n", "rep")
    member = member.unionByName(signed.where("n = 0").select("_rid", "doc_id", "n", F.col("_rid").alias("rep")))
    reps = signed.join(classes.select(F.col("rep").alias("_rid")), "_rid").select("_rid", "bands", "sig")
    banded = reps.select(F.col("_rid").alias("rid"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("rid", "key").alias("h"), "rid")).alias("first")).where("n > 1")
    shared = write_table(banded.join(buckets.select("key", F.col("first.rid").alias("leader")), "key"), "near-shared")
    involved = shared.select(F.col("rid").alias("_rid")).distinct()
    texts = write_table(rows.select("_rid", "text").join(involved, "_rid", "left_semi"), "near-texts")
    sigs = write_table(signed.select("_rid", "sig").join(_prints(texts, size), "_rid"), "near-sigs")
    bar = threshold / 100 - SLACK
    pairs = shared.where("rid != leader").select(F.col("rid").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("_rid").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("_rid").alias("b"), F.col("sig").alias("y")), "b")
    best = pairs.select("a", "b", estimate(F.col("x"), F.col("y")).alias("est")).where(F.col("est") >= bar).groupBy("a").agg(F.max(F.struct("est", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = write_table(_confirmed(write_table(best, "near-pairs"), texts, size, threshold), "near-links")
    tested = None
    labels = write_table(components(links), "near-labels")
    for most in MEETINGS:
        met = _meet(shared, labels, sigs, bar, threshold, most)
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        met = write_table(met.select("a", "b"), "near-met")
        if met.isEmpty():
            break
        tested = met if tested is None else tested.unionByName(met)
        more = write_table(_confirmed(met, texts, size, threshold), "near-links")
        if not more.isEmpty():
            stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = write_table(components(stars.unionByName(more)), "near-labels")
    out = member.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("_rid", "doc_id", "n", F.coalesce("component", "rep").alias("component"))
    out = write_table(out, "near-members")
    # written, so that the join has two plain shuffles and the rows of one component can be split
    least = write_table(out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")).alias("first")), "near-least")
    out = out.join(least, "component")
    return out.select("_rid", "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("_rid") == F.col("first._rid")).alias("kept"))


def op5_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
