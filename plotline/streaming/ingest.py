"""Incremental ingest with Structured Streaming: latest-wins by event time, calendar buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.operators.windows import latest


def _drain(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Runs the query over what is there and returns its result as a table. Each batch is written beside the checkpoint
    under its id, and one that is replayed replaces itself; in complete mode the last one is the result."""
    root, done = f"{checkpoint}-rows", []

    def put(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/{batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if path not in done:
            done.append(path)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(done[-1:] if mode == "complete" else done))


def checkpoint_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``). Where that setting is absent,
    a local master gets a temporary folder, any other one an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def latest_by_event_time(stream: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Streaming aggregate: per key the row with the greatest order columns, so that a late older extract never wins."""
    return stream.groupBy(key).agg(F.max(F.struct(*order, *[f for f in fields if f not in order])).alias("top"), F.count(F.lit(1)).alias("versions")).select(key, "versions", "top.*")


def tumbling_counts(stream: DataFrame, ts: str, width: str, keys: Sequence[str], delay: str = "30 days") -> DataFrame:
    """Counts per key and calendar bucket, with a watermark so that old state is dropped."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    g = s.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("bucket"), *keys, "n")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    return _drain(stream, mode, checkpoint_dir(stream.sparkSession))


def ingest(stream: DataFrame, root: str, key: Sequence[str], order: Sequence, checkpoint: str) -> None:
    """Appends each micro-batch under its batch id and registers it last: a batch replayed after a failure replaces
    itself. The current view is taken over all registered batches, by event time and not by arrival."""
    from plotline.sources.sinks import commit_batch

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, key, order)
        commit_batch(str(batch_id), {"observations": rows}, rows.agg(F.count(F.lit(1)).alias("rows")), root)

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
