"""Archives of XML members: a data source that deals an archive's members out by ranges, and their registered ingest."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plotline.operators import xml_records as XML
from plotline.sources import readers, sinks
from plotline.sources.scratch import cut

#: Bytes of (unpacked) members that one task reads, about.
RANGE_BYTES = 16 << 20
_BATCH = 200
SCHEMA = "archive string, path string, ordinal int, name string, bytes long, content binary"


def _open(path: str):
    """A seekable file of any file system that Arrow knows (local, HDFS, S3, ...)."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(name)


class MemberRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


class MemberReader(DataSourceReader):
    """Reads the archives' directories when it plans, and a range of members in each task."""

    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[MemberRange]:
        out = []
        for path in self.paths:
            with _open(path) as f, zipfile.ZipFile(f) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
            total = sum(i.file_size for i in infos)
            if len(infos) > readers.MAX_MEMBERS or total > readers.MAX_ARCHIVE:
                raise ValueError(f"{path}: over the limits of an archive ({len(infos)} members, {total} bytes)")
            first, held = 0, 0
            for at, info in enumerate(infos, 1):
                held += info.file_size
                if held >= self.size or at == len(infos):
                    out.append(MemberRange(path, first, at))
                    first, held = at, 0
        return out or [MemberRange("", 0, 0)]

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        path, first, last = partition.value
        if not path:
            return
        archive = path.rsplit("/", 1)[-1]
        with _open(path) as f, zipfile.ZipFile(f) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            for at in range(first, last, _BATCH):
                part = infos[at : min(at + _BATCH, last)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(part)), pa.array([path] * len(part)), pa.array(range(at + 1, at + 1 + len(part)), pa.int32()), pa.array([i.filename for i in part]), pa.array([i.file_size for i in part], pa.int64()),
                     pa.array([z.read(i) if i.file_size <= readers.MAX_MEMBER else None for i in part], pa.binary())],
                    names=["archive", "path", "ordinal", "name", "bytes", "content"],
                )


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def scan_members(spark: SparkSession, paths: list[str], *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, path, ordinal, name, bytes, content) of the archives' members, ordinals from 1: tasks take ranges of
    about ``range_bytes`` of an archive, so that a large one is read by many and never held whole. An archive over its
    limits (members, unpacked bytes) raises; a member over its own has a null content."""
    spark.dataSource.register(MemberSource)
    return spark.read.format("archive_members").option("paths", json.dumps(paths)).option("rangebytes", str(range_bytes)).load()


def _registered(spark: SparkSession, root: str, parser: str) -> DataFrame:
    """(archive_sha256) of the archives that a committed batch has read with this version of the parser."""
    known = "archive_sha256 string, parser_version string, batch_id string"
    done = spark.read.option("basePath", f"{root}/registry").parquet(f"{root}/registry") if sinks._exists(spark, f"{root}/registry") else spark.createDataFrame([], known)
    return done.where(F.col("parser_version") == parser).select("archive_sha256")


def store_archives(batch: DataFrame, batch_id: str, root: str, parser: str) -> int:
    """Reads the archives of (path, length, archive_sha256) rows that no batch has registered with this parser's version,
    and commits their observations, versions, child rows, events and registry rows in one batch. Returns how many."""
    spark = batch.sparkSession
    new = batch.join(_registered(spark, root, parser), "archive_sha256", "left_anti")
    new = cut(new.groupBy("archive_sha256").agg(F.min("path").alias("path"), F.first("length").alias("archive_bytes")), "archives")
    paths = [r.path for r in new.select("path").orderBy("path").collect()]
    if not paths:
        return 0
    at = F.try_to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})[^/]*$", 1), F.lit("yyyy-MM-dd-HH-mm-ss"))
    members = scan_members(spark, paths).join(new.select("path", "archive_sha256"), "path")
    disposed = cut(XML.member_dispositions(XML.parse_members(members.withColumn("archive", F.col("archive_sha256")))), "members")
    valid = disposed.where("disposition = 'valid'").withColumn("version_id", F.concat("raw_sha256", F.lit(f":{parser}")))
    versions = valid.drop("archive", "path", "archive_sha256", "ordinal", "name", "bytes", "disposition", "issue_code").dropDuplicates(["version_id"])
    if sinks._exists(spark, f"{root}/versions"):
        others = sinks.committed(spark, root, "versions").where(F.col("batch_id") != batch_id).select("version_id")
        versions = versions.join(others, "version_id", "left_anti")
    versions = cut(versions, "versions")
    status = XML.batch_status(disposed).withColumnRenamed("archive", "archive_sha256")
    registry = status.join(new, "archive_sha256").select("*", at.alias("extract_timestamp"), F.lit(parser).alias("parser_version"))
    tables = {
        "observations": valid.select("archive_sha256", "ordinal", "name", "source_key", "version_id", "raw_sha256"),
        "versions": versions.drop(*XML.CHILDREN), "children": XML.child_rows(versions, ["version_id", "source_key"]),
        "events": XML.member_events(disposed).withColumnRenamed("archive", "archive_sha256"),
    }
    sinks.commit_batch(batch_id, tables, registry, root)
    return len(paths)


def ingest_archives(spark: SparkSession, path: str, root: str, *, parser: str, checkpoint: str) -> None:
    """Streams the archives of a folder into the store below ``root``: each micro-batch hashes its archives and skips those
    that are registered under their hash and the parser's version, whatever they are called now. A batch that broke off
    has no registry row, so that a replay reads its archives again; a new version of the parser starts a stream of its own
    and reads all archives once more."""
    schema = spark.read.format("binaryFile").load(path).schema
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    hashed = found.select("path", "length", F.sha2("content", 256).alias("archive_sha256"))
    put = lambda batch, i: store_archives(batch, f"{parser}-{i}", root, parser) and None
    hashed.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/{parser}").trigger(availableNow=True).start().awaitTermination()
