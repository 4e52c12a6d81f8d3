"""Quality rules, near-duplicate removal, privacy, mixing and packing of the documents table, one after the other.

Each stage takes what its predecessor kept, whole, and its decisions take effect: rejected documents and all but one of
each near-duplicate group go, personal data are replaced, documents the mix leaves out go and those it takes twice are
repeated. The last stage returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm.common import write_table
from plotline.llm.minhash import drop_near_duplicates
from plotline.llm.mixing import mix_documents
from plotline.llm.packing import pack
from plotline.llm.pii import sanitize
from plotline.llm.quality import FIGURES, quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # columns of documents named like the operator's own figures keep their values
    own = {c: f"given_{c}_{i}" for i, c in enumerate(docs.columns) if c in (*FIGURES, "base_failed", "kept")}
    return quality_rules(docs.withColumnsRenamed(own)).where("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitize(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("privacy", privacy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Minima of hashes, pivotal draws and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_table(docs, f"pipeline-{k}")
    return docs
