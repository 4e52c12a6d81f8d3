"""Tables on the way: what iterations leave behind, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from plotline.streaming.ingest import checkpoint_dir


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it again: cuts lineage and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}-{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
