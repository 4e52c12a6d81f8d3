"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm.common import write_table

#: Steps of a vector entry's unit: an entry c counts as floor(SCALE * c).
SCALE = 256
#: Vectors in one stored block.
BLOCK_ROWS = 2048
#: Directions that a pass carries beyond those asked for; they widen the gap to the damped part of the spectrum.
GUARD = 12
#: Passes of one polynomial filter.
DEGREE = 12
#: A pair (e, v) is certified once the norm of V v - e v is at most this share of the largest eigenvalue.
TOLERANCE = 1e-13
MAX_FILTERS = 100


@dataclass
class Whitening:
    """A fit: ``n`` vectors with exact sums, eigenvalues (falling) and unit eigenvectors (columns) of their covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float


def _usable(vec: str):
    """Vectors that are not null or empty and hold finite numbers only."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def _blocks(x: DataFrame, d: int) -> DataFrame:
    """The vectors of column ``x`` packed as 64-bit integers, up to BLOCK_ROWS in a row, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for at in range(0, len(flat), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([flat[at : at + BLOCK_ROWS].tobytes()], pa.binary())], names=["body"])

    return write_table(x.mapInArrow(run, "body binary"), "whitening")


def _summed(blocks: DataFrame, d: int, rows: int, cols: int, part) -> np.ndarray:
    """The sum over all blocks of ``part(vectors)``, a rows x cols matrix: each task adds its own blocks up, Spark adds
    the tasks' rows; only rows x cols numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((rows, cols))
        for batch in batches:
            for body in batch.column(0):
                acc += part(np.frombuffer(body.as_buffer(), np.int64).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *[pa.array(acc[:, j].copy()) for j in range(cols)]], names=["i", *names])

    names = [f"c{j}" for j in range(cols)]
    out = blocks.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    got = np.zeros((rows, cols))
    for r in out.collect():
        got[r.i] = r[1:]
    return got


def _moments(blocks: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                x = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, len(x))), pa.array(x.sum(axis=0))], names=["i", "n", "s"])

    rows = blocks.mapInArrow(run, "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = np.zeros(d, object)
    for r in rows:
        sums[r.i] = int(r.s)
    return (rows[0].n if rows else 0), sums


def fit(blocks: DataFrame, d: int, components: int) -> Whitening | None:
    """The leading eigenpairs of the blocks' covariance (divisor n); None without vectors or without any variance.

    Each pass multiplies a d x k block of directions by the centred vectors and back, on the executors. A filter is a
    Chebyshev polynomial of DEGREE passes that stays small between 0 and the smallest Ritz value of the block and grows
    beyond; QR and Rayleigh-Ritz follow, until every asked pair is certified. Pairs without variance are left out."""
    n, sums = _moments(blocks, d)
    if n == 0:
        return None
    mean = np.array([int(s) / n for s in sums])
    spark = blocks.sparkSession
    trace = float(_summed(blocks, d, 1, 1, lambda x: np.array([[((x - mean) ** 2).sum()]]))[0, 0]) / n
    if trace == 0:
        return None
    k = min(d, components + GUARD)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        held = spark.sparkContext.broadcast(q)
        got = _summed(blocks, d, d, k, lambda x: (c := x - mean).T @ (c @ held.value)) / n
        held.destroy()
        return got

    q = np.linalg.qr(np.random.default_rng(11).standard_normal((d, k)))[0]
    before = np.inf
    for _ in range(MAX_FILTERS):
        y = times(q)
        ritz, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        asked = slice(0, min(components, k))
        residual = float(np.linalg.norm(y[:, asked] - q[:, asked] * ritz[asked], axis=0).max() / ritz[0])
        if residual <= TOLERANCE or k == d or (residual < 1e-11 and residual > before / 2):
            break  # certified; or the block is the whole space; or only rounding is left
        before = residual
        half = max(ritz[-1], 1e-12 * ritz[0]) / 2  # the damped interval is [0, 2 half]
        older, newer = q, (y - half * q) / half
        top = ritz[0] / half - 1
        scale = top  # keeps the largest direction near 1
        newer = newer / scale
        for _ in range(DEGREE - 1):
            grown = 2 * top - 1 / scale
            older, newer = newer, (2 * (times(newer) - half * newer) / half - older / scale) / grown
            scale = grown
        q = np.linalg.qr(newer)[0]
    else:
        raise RuntimeError(f"no certified eigenpairs after {passes} passes (residual {residual:.2e})")
    keep = [j for j in range(min(components, k)) if ritz[j] > 1e-12 * trace]
    values, vectors = ritz[keep], q[:, keep]
    p = vectors / np.sqrt(values)
    m = len(keep)

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ p
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _summed(blocks, d, m + 1, m, spread) / n
    error = float(np.abs(got[:m] - np.outer(got[m], got[m]) - np.eye(m)).max())
    return Whitening(n, sums, values, vectors, trace, residual, passes, error)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable row of ``df`` and each of the leading ``components``: id, component (from 1), n, deviation,
    whitened, explained, identity_error.

    An entry c counts as x = floor(256 c). The fit takes each distinct x vector once: n vectors with sums S, covariance V
    with divisor n and eigenpairs (e, v). deviation is the exact sum of (n x - S)^2 (an error beyond 63 bits), whitened the
    projection of x - S/n on v over sqrt(e), explained e / trace(V), identity_error the largest entry of what the whitened
    fit list's covariance differs from the identity by.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are vectors of another length
    than the most frequent one (the shorter at a tie). Repeated rows and null ids give rows of their own. Components
    without variance do not exist, so that one distinct vector, or none, gives no rows. Other columns play no part."""
    rows = df.select(F.col(id_col).alias(id_col), F.col(vec_col).alias("_v")).where(_usable("_v"))
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark: SparkSession = df.sparkSession
    usual = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], schema)
    d = usual[0].d
    rows = rows.where(F.size("_v") == d)
    x = F.transform("_v", lambda c: F.floor(c.cast("double") * SCALE))
    w = fit(_blocks(rows.select(x.alias("x")).distinct(), d), d, components)
    if w is None:
        return spark.createDataFrame([], schema)
    mean = np.array([int(s) / w.n for s in w.sums])
    p, explained, m = w.vectors / np.sqrt(w.values), w.values / w.trace, len(w.values)
    fits = max(abs(int(s)) for s in w.sums) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            x = np.floor(v * SCALE).astype(np.int64)
            whitened = (x - mean) @ p
            if fits and float(np.abs(x - mean).max()) * w.n < 2.0**62 / (1 << 31) / np.sqrt(d):
                off = x * w.n - w.sums.astype(np.int64)
                deviation = pa.array((off * off).sum(axis=1))
            else:
                off = x.astype(object) * w.n - w.sums
                deviation = pa.array([int(r) for r in (off * off).sum(axis=1)], pa.int64())
            each = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.n)), deviation.take(pa.array(each)),
                 pa.array(whitened.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), w.identity_error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op11_chebyshev_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
