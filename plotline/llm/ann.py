"""Nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately by k-means (fitted on at most SAMPLE vectors), which cuts space into
``halves x halves`` cells. A query visits pairs of centroids by summed distance, with a heap, until the cells visited hold
the share of all vectors that `visit_share` asks for; the entries met are ranked by their exact distance. Every vector is
indexed.

How well centroids order vectors is measured on sample vectors, as the share that holds RECALL of their true neighbours
among the sample; `visit_share` carries it on to the number of vectors there are. The share falls as the table grows or
as its vectors cluster.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import write_table

#: Centroids a half: half the square root of the number of vectors, in these bounds.
HALVES = (16, 1024)
#: Vectors, and bytes of them, that the codebooks are fitted on; further ones that measure the visits.
SAMPLE, SAMPLE_BYTES, MEASURE, MEASURE_QUERIES = 20_000, 1 << 26, 5_000, 300
RECALL = 0.97
BLOCK_ROWS, ASKED_ROWS = 8_192, 256
_NORMAL = NormalDist()


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = points[near == j].mean(0)
    return centres


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _gaps(points, centres).argmin(1)


def visit_cells(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: float) -> list[int]:
    """Cells (i * len(second) + j) by first[i] + second[j], ascending, until they hold ``enough`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, n = first[a].tolist(), second[b].tolist(), len(second)
    cells, got, heap = [], 0, [(x[0] + y[0], 0, 0)]
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * n + int(b[j])
        got += int(held[cell])
        cells.append(cell)
        if j + 1 < n:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return cells


def visit_share(n: int, k: int, likeness: float, recall: float = RECALL) -> float:
    """Share of ``n`` vectors to visit for ``recall`` of the ``k`` nearest, where true distances and distances to
    centroids correlate by ``likeness``, as two normal variables."""
    if k >= n:
        return 1.0
    z = likeness * _NORMAL.inv_cdf(k / n) + _NORMAL.inv_cdf(recall) * (1 - likeness**2) ** 0.5
    return max(k / n, _NORMAL.cdf(z))


def likeness(points: np.ndarray, books: list[np.ndarray], k: int, queries: int = MEASURE_QUERIES) -> float:
    """The correlation with which `visit_share` gives the share that these points' true neighbours need."""
    n, half = len(points), points.shape[1] // 2
    if n <= k + 1:
        return 0.0
    asked = points[:queries]
    true, rough = _gaps(asked, points), np.zeros((len(asked), n))
    for part, book in ((slice(0, half), books[0]), (slice(half, None), books[1])):
        rough += _gaps(asked[:, part], book)[:, _nearest(points[:, part], book)]
    own = np.arange(len(asked))
    true[own, own] = np.inf
    rough[own, own] = np.inf
    places = np.argsort(np.argsort(rough, axis=1, kind="stable"), axis=1)
    near = np.argpartition(true, k, axis=1)[:, :k]
    needed = float(np.quantile((np.take_along_axis(places, near, 1) + 1) / (n - 1), RECALL))
    low, high = 0.0, 1.0
    for _ in range(40):  # the share falls as the likeness grows
        mid = (low + high) / 2
        low, high = (mid, high) if visit_share(n - 1, k, mid) > needed else (low, mid)
    return low


def _blocks(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell: runs of small cells share a block, large cells take several."""
    first, parts = np.zeros(len(held), np.int64), np.maximum(1, -(-held // BLOCK_ROWS))
    block = room = 0
    for cell in np.flatnonzero(held).tolist():
        n = int(held[cell])
        if room and room + n > BLOCK_ROWS:
            block, room = block + 1, 0
        first[cell] = block
        room += n
        if parts[cell] > 1:
            block, room = block + int(parts[cell]), 0
    return first, parts


def _meet(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, asks, id, cells, vec) sorted by block and asks -> (query_id, vec_id, score) of each query's nearest
    in each block. A block's entries come first and are held; its queries pass by in portions."""
    block, entries, known = None, [], None

    def rows(b: pa.RecordBatch, at: np.ndarray) -> tuple:
        part = b.take(pa.array(at))
        cells = part.column(3)
        return np.array(part.column(2)), np.array(cells.flatten()), np.diff(np.array(cells.offsets)), np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(-1, dims)

    def answer(asked: tuple) -> pa.RecordBatch:
        ids, cells, e, e2 = known
        out: list[tuple[int, int, float]] = []
        q_ids, q_cells, counts, q = asked
        q2, ends = (q * q).sum(1), np.cumsum(counts)
        near = e2[None] + q2[:, None] - 2 * (q @ e.T)
        for i, qid in enumerate(q_ids.tolist()):
            seen = np.isin(cells, q_cells[ends[i] - counts[i] : ends[i]]) & (ids != qid)
            n = int(seen.sum())
            if not n:
                continue
            row = np.where(seen, near[i], np.inf)
            bar = np.partition(row, min(k, n) - 1)[min(k, n) - 1]
            close = np.flatnonzero(seen & (row <= bar + 1e-9 * (q2[i] + e2.max())))
            exact = np.sqrt(((e[close] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[close], exact))[:k]
            out += [(qid, int(ids[close[j]]), float(exact[j])) for j in best]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    for b in batches:
        blocks, asks = np.array(b.column(0)), np.array(b.column(1))
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
            if hi <= lo:
                continue
            if blocks[lo] != block:
                block, entries, known = blocks[lo], [], None
            own = np.arange(lo, hi)
            if (~asks[own]).any():
                entries.append(rows(b, own[~asks[own]]))
            wanted = own[asks[own]]
            for at in range(0, len(wanted), ASKED_ROWS):
                if known is None:
                    vec = np.concatenate([x[3] for x in entries])
                    known = np.concatenate([x[0] for x in entries]), np.concatenate([x[1] for x in entries]), vec, (vec * vec).sum(1)
                yield answer(rows(b, wanted[at : at + ASKED_ROWS]))


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, halves: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by ``every``, the ``k`` nearest other rows found.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id or
    vectors of another length than the most frequent one. Rows sharing the query's id count as the query's own.
    Ties go to the smaller id. Equal vectors may number a third of all rows: blocks of a cell are cut to a fixed size.
    The codebooks are fitted on ``sample`` vectors at most, drawn by the hash of their id. Each block of entries is
    shuffled once, queries go to the blocks that they visit.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    sizes = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = sizes[0]["d"], sizes[0]["count"]
    v = v.where(F.size("vec") == dims)
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dims)))
    take = min(1.0, 1.1 * (sample + MEASURE) / total)
    some = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(take * (1 << 20)) + 1).limit(sample + MEASURE)
    points = np.array([r["vec"] for r in some.select("vec").collect()], float)
    if not len(points):  # all ids equal, say
        points = np.array([r["vec"] for r in v.select("vec").limit(sample).collect()], float)
    fitted = points[:sample] if len(points) > sample + 1000 else points
    half, wide = dims // 2, halves or int(min(max(HALVES[0], total**0.5 / 2), HALVES[1]))
    books = [kmeans(fitted[:, :half], wide), kmeans(fitted[:, half:], wide)]
    wide = len(books[1])
    share = visit_share(total, k, likeness(points[-MEASURE:], books, k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            m = np.array(b.column(1).flatten(), dtype=np.float64).reshape(-1, dims)
            cells = _nearest(m[:, :half], books[0]) * wide + _nearest(m[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "cell", "vec"])

    index = write_table(v.mapInArrow(assign, "vec_id long, cell int, vec binary"), "ann-index")
    counts = index.groupBy("cell").count().toArrow()  # one row per cell: halves squared at most
    held = np.zeros(len(books[0]) * wide, np.int64)
    held[np.array(counts.column("cell"))] = np.array(counts.column("count"))
    first, parts = _blocks(held)
    queries = index.where(F.col("vec_id") % every == 0)
    own = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    enough = share * total + k + own

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, ids = np.array(b.column(1)), np.array(b.column(0)).astype(np.uint64)
            part = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cells]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1), pa.int32()), b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(first[cells] + part), pa.array(np.zeros(len(cells), bool)), b.column(0), lists, b.column(2)], names=["block", "asks", "id", "cells", "vec"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m = np.frombuffer(b.column(2)[i].as_py(), np.float64)[None]
                cells = np.array(visit_cells(_gaps(m[:, :half], books[0])[0], _gaps(m[:, half:], books[1])[0], held, enough))
                cells = cells[held[cells] > 0]
                times = parts[cells]  # a cell cut into several blocks is visited in each
                at = np.repeat(first[cells] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                order = np.argsort(at, kind="stable")
                at, cells = at[order], np.repeat(cells, times)[order]
                begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), pa.array(cells, pa.int32()))
                same = pa.array(np.full(len(begin), i))
                yield pa.RecordBatch.from_arrays([pa.array(at[begin]), pa.array(np.ones(len(begin), bool)), b.column(0).take(same), lists, b.column(2).take(same)], names=["block", "asks", "id", "cells", "vec"])

    schema = "block long, asks boolean, id long, cells array<int>, vec binary"
    both = index.mapInArrow(place, schema).unionByName(queries.mapInArrow(route, schema)).repartition("block").sortWithinPartitions("block", "asks")
    found = both.mapInArrow(lambda it: _meet(it, dims, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multi_index(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
