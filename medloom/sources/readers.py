"""Scans: checksums, tolerant CSV, nested XML."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .registry import Registry

DISORDER = (
    "OrphaCode string, Name struct<_VALUE:string,_lang:string>, "
    "PrevalenceList struct<Prevalence:array<struct<PrevalenceType:struct<Name:struct<_VALUE:string,_lang:string>>,"
    "PrevalenceClass:struct<Name:struct<_VALUE:string,_lang:string>>,PrevalenceGeographic:struct<Name:struct<_VALUE:string,_lang:string>>,"
    "PrevalenceValidationStatus:struct<Name:struct<_VALUE:string,_lang:string>>>>>, "
    "SynonymList struct<Synonym:array<struct<_VALUE:string,_lang:string>>>"
)


WHOLE_BYTES = 1 << 30  # Spark reads a binary file as one value, which ends at 2 GB
HELD_BYTES = 1 << 24  # of a file that its task can open itself; Spark's reader holds each whole file several times
CHUNK_BYTES = 1 << 23


class DigestFile(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class DigestReader(DataSourceReader):
    """One task per file; a task holds one chunk of it."""

    def __init__(self, files: list[tuple[str, int]], chunk: int):
        self.files, self.chunk = files, chunk

    def partitions(self) -> list[DigestFile]:
        return [DigestFile(path, size) for path, size in self.files]

    def read(self, partition: DigestFile) -> Iterator[tuple[str, int, str]]:
        from pyarrow import fs

        if partition.path.startswith("file:"):
            system, path = fs.LocalFileSystem(), "/" + partition.path.removeprefix("file:").lstrip("/")
        else:
            system, path = fs.FileSystem.from_uri(quote(partition.path, safe=":/@"))
        digest, size = hashlib.sha256(), 0
        with system.open_input_stream(path) as stream:
            while block := stream.read(self.chunk):
                digest.update(block)
                size += len(block)
        if size != partition.size:
            raise OSError(f"{partition.path} changed while it was read: {size} of {partition.size} bytes")
        yield partition.path, size, digest.hexdigest()


class DigestSource(DataSource):
    """Streams files through SHA-256 in their tasks; options ``files`` (JSON pairs of URI and size) and ``chunk``."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, bytes bigint, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DigestReader([(p, int(n)) for p, n in json.loads(self.options["files"])], int(self.options["chunk"]))


def file_digests(spark: SparkSession, paths: list[str], whole: int = WHOLE_BYTES, chunk: int = CHUNK_BYTES, held: int = HELD_BYTES) -> DataFrame:
    """(path, bytes, sha256), one task per file and files of any size.

    Files of up to ``whole`` bytes are read by Spark's own reader, so any file system it opens will
    do. Larger ones, which it cannot hold as one value, stream chunk by chunk through the digest;
    their file system must be one that pyarrow opens too. Where all files lie in a mounted folder, those
    beyond ``held`` bytes stream as well. Listing reads no content. Spark's reader
    makes no row of an empty file, so those are added by name. Names of files, not their bytes, pass
    through the driver.
    """
    listed = spark.read.format("binaryFile").load(paths)
    files = listed.inputFiles()
    if all(p.startswith("file:") for p in files):
        whole = min(whole, held)
    names = spark.createDataFrame([(unquote(p).replace("file:///", "file:/", 1),) for p in files], "path string")
    empty = names.join(listed.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("sha256"))
    small = listed.where(F.col("length") <= whole).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = [[r["path"], r["length"]] for r in listed.where(F.col("length") > whole).select("path", "length").collect()]
    if not large:
        return small.unionByName(empty)
    spark.dataSource.register(DigestSource)
    streamed = spark.read.format("file_digests").option("files", json.dumps(large)).option("chunk", chunk).load()
    return small.unionByName(streamed).unionByName(empty)


def verify_checksums(spark: SparkSession, registry: Registry, data_dir: str) -> DataFrame:
    """(name, path, sha256) of every registered file; raises when one is missing or changed."""
    from .registry import registry_frame

    known = registry_frame(spark, registry).select("name", "file", F.col("sha256").alias("expected"))
    found = file_digests(spark, [f"{data_dir}/{s.file}" for s in registry.sources.values()])
    named = found.withColumn("file", F.element_at(F.split(F.url_decode(F.col("path")), "/"), -1))
    joined = known.withColumn("file", F.element_at(F.split("file", "/"), -1)).join(named, "file", "left")
    bad = [r["name"] for r in joined.where("sha256 IS NULL OR sha256 <> expected").select("name").collect()]
    if bad:
        raise RuntimeError(f"checksum mismatch: {sorted(bad)}; audit the files again before changing the registry")
    return joined.select("name", "path", "sha256")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All-string scan in one pass; undecodable bytes become U+FFFD, quoted newlines are kept."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", False)
    return reader.csv(path)


def _disorders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Disorder").schema(DISORDER).load(path).where("OrphaCode IS NOT NULL")


def read_prevalence(spark: SparkSession, path: str) -> DataFrame:
    """(orphacode, name, type, class, geography, validation, pos): one row per estimate."""
    p = _disorders(spark, path).select(
        F.col("OrphaCode").alias("orphacode"), F.col("Name._VALUE").alias("name"), F.posexplode("PrevalenceList.Prevalence").alias("pos", "p"))
    text = lambda f: F.col(f"p.{f}.Name._VALUE")
    return p.select("orphacode", "name", text("PrevalenceType").alias("type"), text("PrevalenceClass").alias("class"),
                    text("PrevalenceGeographic").alias("geography"), text("PrevalenceValidationStatus").alias("validation"), "pos")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(orphacode, name, is_synonym, pos): the name first, then its synonyms in order."""
    d = _disorders(spark, path)
    own = d.select(F.col("OrphaCode").alias("orphacode"), F.col("Name._VALUE").alias("name"), F.lit(False).alias("is_synonym"), F.lit(0).alias("pos"))
    other = d.select(F.col("OrphaCode").alias("orphacode"), F.posexplode("SynonymList.Synonym").alias("i", "s")).select(
        "orphacode", F.col("s._VALUE").alias("name"), F.lit(True).alias("is_synonym"), (F.col("i") + 1).alias("pos"))
    return own.unionByName(other.where("name IS NOT NULL AND name <> ''"))
