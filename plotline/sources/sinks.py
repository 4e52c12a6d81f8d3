"""Sinks: Parquet and CSV by Spark's committers, batch registry, snapshot-pinned exports, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Zstandard Parquet; an empty frame still writes its schema. The job's committer makes it all or nothing."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Insert or ignore: appends one row of each key that the table lacks."""
    new = df.dropDuplicates(keys)
    if _exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)


def commit_batch(batch_id: str, tables: dict[str, DataFrame], registry: DataFrame, root: str) -> None:
    """Writes a batch's tables under batch_id=..., then its registry row: the row is the commit mark, so a batch that
    broke off is written again from the start and never read half."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    registry.write.mode("overwrite").parquet(f"{root}/registry/batch_id={batch_id}")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table whose batches are registered."""
    done = spark.read.option("basePath", f"{root}/registry").parquet(f"{root}/registry").select(F.col("batch_id").cast("string")).distinct()
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").withColumn("batch_id", F.col("batch_id").cast("string"))
    return rows.join(done, "batch_id", "left_semi")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    _write_text(spark, path, json.dumps(facts, sort_keys=True, indent=1))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) if _exists(spark, path) else None


def export_once(df: DataFrame, path: str, snapshot: str) -> bool:
    """Writes the export unless the manifest beside it names the same snapshot; tells whether it wrote."""
    spark = df.sparkSession
    if (read_manifest(spark, f"{path}.manifest.json") or {}).get("snapshot") == snapshot:
        return False
    write_parquet(df, path)
    write_manifest(spark, f"{path}.manifest.json", snapshot=snapshot, columns=df.columns)
    return True
