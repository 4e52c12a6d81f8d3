"""Sources: disclosure files, archives of XML members, macro series, boundaries."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.operators.joins import require

#: Limits of an archive: members, its bytes, a member's bytes.
MAX_MEMBERS, MAX_ARCHIVE, MAX_MEMBER = 100_000, 1 << 30, 10 << 20
#: The two layouts of annual files: encoding, separator, columns that must be there.
LAYOUTS = {
    "modern": ("UTF-16", "\t", ("SDF_ID", "County_ID", "C7_Conveyance_Date", "E1_Sales_Price")),
    "legacy": ("windows-1252", "|", ("SDF_ID", "County_ID", "Conveyance_Date", "C6_Sales_Price")),
}


def first_line(spark: SparkSession, path: str, encoding: str) -> str:
    """First line of a file, read by Spark (any store that Spark reads), with at most its first 64 KB looked at."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("c")).first()["c"]
    try:
        return bytes(head).decode({"UTF-16": "utf-16", "windows-1252": "cp1252"}[encoding], "ignore").splitlines()[0]
    except (UnicodeError, IndexError):
        return ""


def detect_layout(spark: SparkSession, path: str) -> str:
    """The first layout whose required columns the header holds."""
    for name, (encoding, sep, required) in LAYOUTS.items():
        if set(required) <= {c.strip('"') for c in first_line(spark, path, encoding).split(sep)}:
            return name
    raise ValueError(f"{path}: no known layout")


def read_delimited(spark: SparkSession, path: str, *, encoding: str, sep: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Delimited file, all columns as strings, pruned to the wanted ones; absent optional columns are null. UTF-16
    cannot be split by lines, so each such file is one task. Windows-1252 is read as Latin-1, which Spark knows, and
    the 27 characters that differ are put right."""
    windows = encoding.lower().startswith("windows")
    raw = spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1" if windows else encoding, inferSchema=False, multiLine=encoding.upper().startswith("UTF-16"))
    require(raw, required, path)
    if windows:
        other = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
        raw = raw.select(*[F.translate(F.col(f"`{c}`"), "".join(other), "".join(other.values())).alias(c) for c in raw.columns])
    return raw.select(*[F.col(f"`{c}`") for c in required], *[F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string").alias(c) for c in optional])


def read_sales(spark: SparkSession, path: str, optional: Sequence[str] = ()) -> DataFrame:
    encoding, sep, required = LAYOUTS[detect_layout(spark, path)]
    return read_delimited(spark, path, encoding=encoding, sep=sep, required=required, optional=optional)


def discover_annual(names: Sequence[str]) -> list[dict]:
    """Annual sources among file names, by year: YYYY.txt, or SALEDISCyyyy.txt with its partner SALEPARCELyyyy.txt, in
    upper or lower case."""
    legacy, modern, parcels = ({m[1]: n for n in names if (m := re.fullmatch(rf"{start}(\d{{4}})\.txt", n, re.I))} for start in ("", "SALEDISC", "SALEPARCEL"))
    if both := sorted(legacy.keys() & modern.keys()):
        raise ValueError(f"two sources for {', '.join(both)}")
    if alone := sorted(modern.keys() - parcels.keys()):
        raise ValueError(f"no parcel file for {', '.join(alone)}")
    out = [{"year": int(y), "layout": "legacy", "sales": n, "parcels": None} for y, n in legacy.items()]
    out += [{"year": int(y), "layout": "modern", "sales": n, "parcels": parcels[y]} for y, n in modern.items()]
    return sorted(out, key=lambda s: s["year"])


def semi_scan(children: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is among the given ones."""
    return children.join(keys.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def read_archives(spark: SparkSession, path: str, *, year: int | None = None, archive: str | None = None, limit: int | None = None) -> DataFrame:
    """Archives below a folder as (archive, path, bytes, extract_timestamp, content): all, those of a year, the one of a
    name, or the first ``limit`` by time and name. One over the size limit raises before any content is read."""
    z = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    at = F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd-HH-mm-ss"))
    z = z.withColumns({"archive": name, "extract_timestamp": at})
    if archive is not None:
        z = z.where(F.col("archive") == archive)
    if year is not None:
        z = z.where(F.year("extract_timestamp") == year)
    if limit is not None:
        first = z.select("path").orderBy(F.asc_nulls_last("extract_timestamp"), "archive", "path").limit(limit)
        z = z.join(first, "path", "left_semi")
    large = z.where(F.col("length") > MAX_ARCHIVE).select("archive").limit(1).collect()
    if large:
        raise ValueError(f"{large[0]['archive']}: larger than {MAX_ARCHIVE} bytes")
    return z.where(F.col("length") <= MAX_ARCHIVE).select("archive", "path", F.col("length").alias("bytes"), "extract_timestamp", "content")


def read_members(archives: DataFrame) -> DataFrame:
    """(archive, ordinal, name, bytes, content) of the archives' members in order, from 1; an archive over its limits raises.
    Each archive is one row in one task; `archives.scan_members` deals a large one out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["archive"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if len(infos) > MAX_MEMBERS:
                        raise ValueError(f"{archive}: more than {MAX_MEMBERS} members")
                    for at in range(0, len(infos), 200):
                        part = infos[at : at + 200]
                        yield pd.DataFrame({"archive": archive, "ordinal": range(at + 1, at + 1 + len(part)), "name": [i.filename for i in part], "bytes": [i.file_size for i in part], "content": [z.read(i) if i.file_size <= MAX_MEMBER else None for i in part]})

    return archives.select("archive", "content").mapInPandas(run, "archive string, ordinal int, name string, bytes long, content binary")


def read_market(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped tab-separated tracker; empty, NA and -- are null."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin("", "NA", "--"), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_table(spark: SparkSession, stem: str) -> DataFrame:
    """stem.parquet, else stem.csv with all columns as strings, else stem.json (an array of objects)."""
    readers = {"parquet": spark.read.parquet, "csv": lambda p: spark.read.csv(p, header=True, inferSchema=False), "json": lambda p: spark.read.json(p, multiLine=True)}
    for kind, read in readers.items():
        try:
            return read(f"{stem}.{kind}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) or kind == "json":
                raise
    raise AssertionError


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, geometry as JSON text) of a GeoJSON file's features."""
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:string>>>"
    return raw.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).select("f.properties", "f.geometry")


def rows_with_header(spark: SparkSession, rows: Sequence[Sequence[object]]) -> DataFrame:
    """An API answer that is an array of arrays, header first, as strings."""
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))
