"""Helpers that the corpus operators share: shared-folder tables, row keys, word positions and hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer single text is handled alone.
BLOCK_BYTES = 1 << 19


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder of this application in the one that driver and executors share (``spark.checkpoint.dir``); Hadoop
    deletes it when the application ends. Where that setting is absent, a local master gets a temporary folder, any
    other one an error: machines of a cluster do not see each other's folders."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            where = "file://" + tempfile.mkdtemp(prefix="spark-")
        _folders[app] = f"{where.rstrip('/')}/plotline-{app}-{uuid.uuid4().hex}"
        _path(spark, _folders[app], lambda fs, path: (fs.mkdirs(path), fs.deleteOnExit(path)))
    return _folders[app]


def _path(spark: SparkSession, folder: str, do: Callable) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    do(path.getFileSystem(spark._jsc.hadoopConfiguration()), path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what the operators have written so far; results not yet read or written elsewhere are lost with it."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        _path(spark, folder, lambda fs, path: fs.delete(path, True))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_unique(df: DataFrame, id_col: str) -> bool:
    """Whether no value of ``id_col`` is null or occurs twice (one aggregation of that column alone)."""
    twice = df.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
    return twice.limit(1).count() == 0


def keyed(df: DataFrame, id_col: str, name: str = "keyed") -> DataFrame:
    """``df`` with a unique long ``_rid``: the id itself where ids are unique longs, else a stored running number."""
    if dict(df.dtypes)[id_col] in ("bigint", "int") and ids_unique(df, id_col):
        return df.withColumn("_rid", F.col(id_col).cast("long"))
    return write_table(df.withColumn("_rid", F.monotonically_increasing_id()), name)


def text_blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into blocks: (first row, last row, bytes, offsets into the bytes). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


_rng = np.random.Generator(np.random.PCG64(20240517))
#: A random value for each byte; upper and lower case A-Z share one in FOLDED.
EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
BASE = int(_rng.integers(1, 1 << 62)) * 4 + 1
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int, inverse: bool) -> np.ndarray:
    """BASE ** i (or its inverse) for i below n, modulo 2 ** 64."""
    got = _powers[inverse]
    if len(got) < n:
        got = np.full(max(n, BLOCK_BYTES + 64), BASE_INV if inverse else BASE, np.uint64)
        got[0] = 1
        _powers[inverse] = got = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(len(data), False), out=p[1:])
    return mix((p[ends] - p[starts]) * _power(len(data) + 1, True)[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``, or of bytes not in ``space``; words never cross documents."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~space[data]
    edge = word[1:] != word[:-1]
    starts, ends = np.flatnonzero(edge & word[1:]), np.flatnonzero(edge & word[:-1])
    cuts = offs[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[word[cuts] & word[cuts + 1]]  # a document ends inside a run of word bytes
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offs, starts, "right") - 1
