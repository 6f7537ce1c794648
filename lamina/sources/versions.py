"""Tables in versions: an upsert is seen whole or not at all, and readers never wait.

A table is a folder with data files by hash bucket and a folder of manifests. A manifest is one small file that
names the folders of every bucket; the newest one is the table. An upsert writes the buckets it touches to new folders,
then publishes a manifest that names these and, for all other buckets, the folders there already are. The
file appears under its number by a rename that fails if the number is taken: of two writers that began
from the same version one is refused, and a job that dies midway leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina.session import durable
from lamina.sources.sinks import upsert_by_source

_MANIFESTS = "_versions"


class VersionConflict(RuntimeError):
    """Another writer published the next version first."""


class _Files:
    """The file system of a path, as Hadoop sees it: local, shared or an object store."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.hadoop = self.jvm.org.apache.hadoop
        self.root = path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, text: str, *parts: str) -> None:
        """Write a file elsewhere and give it its name at once; fails if the name is taken."""
        draft = self.path(*parts[:-1], f".draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE
        try:
            self.hadoop.fs.FileContext.getFileContext(self.path().toUri() if self.path().toUri().getScheme() else self.fs.getUri(), self.conf).rename(
                draft, self.path(*parts), options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                self.fs.delete(draft, False)
                raise VersionConflict(f"{parts[-1]} of {self.root} was published by another writer") from None
            raise

    def remove(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a table, oldest first."""
    return [int(n.removesuffix(".json")) for n in _Files(spark, path).names(_MANIFESTS) if not n.startswith(".")]


def _manifest(files: _Files, number: int) -> dict:
    return json.loads(files.read(_MANIFESTS, f"{number:012d}.json"))


def _newest(spark: SparkSession, path: str, files: _Files) -> int:
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of a table at {path}")
    return known[-1]


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(files: _Files, rows: DataFrame) -> dict[str, list[str]]:
    """Write rows with their ``_bucket`` to a new folder; the folders by bucket, of which there are few."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy("_bucket").parquet(files.path(*folder.split("/")).toString())
    return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in files.names(*folder.split("/")) if n.startswith("_bucket=")}


def create_versioned(df: DataFrame, path: str, key: str = "source_id", buckets: int = 64) -> None:
    """Version 0 of a table. Fails if there is one already."""
    files = _Files(df.sparkSession, path)
    if versions(df.sparkSession, path):
        raise VersionConflict(f"there is a table at {path}")
    parts = _write(files, _bucketed(df, key, buckets))
    files.publish(json.dumps({"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "parts": parts}), _MANIFESTS, f"{0:012d}.json")


def read_versioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as its newest version has it, or an older one that is still kept."""
    files = _Files(spark, path)
    manifest = _manifest(files, _newest(spark, path, files) if version is None else version)
    return _read(spark, files, manifest, list(manifest["parts"]))


def _read(spark: SparkSession, files: _Files, manifest: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [files.path(*f.split("/")).toString() for b in buckets for f in manifest["parts"].get(b, [])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_versioned(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Publish a version in which the sources of ``new`` have the rows of ``new`` and no others; returns its number.

    Only buckets that ``new`` touches are read and written. No rows change nothing, but there is a new version.
    """
    files = _Files(spark, path)
    number = _newest(spark, path, files)
    manifest = _manifest(files, number)
    key, buckets = manifest["key"], manifest["buckets"]
    incoming = durable(_bucketed(new.select(*[c["name"] for c in manifest["schema"]["fields"]]), key, buckets))
    touched = [str(r[0]) for r in incoming.select("_bucket").distinct().collect()]  # at most ``buckets`` rows
    parts = dict(manifest["parts"])
    if touched:
        old = _bucketed(_read(spark, files, manifest, touched), key, buckets)
        parts |= _write(files, upsert_by_source(old, incoming, key))
    files.publish(json.dumps({**manifest, "parts": parts}), _MANIFESTS, f"{number + 1:012d}.json")
    return number + 1


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Forget all but the ``keep`` newest versions and remove the folders that no other version names; the numbers forgotten."""
    files = _Files(spark, path)
    known = versions(spark, path)
    gone, kept = known[:-keep], known[-keep:]
    needed = {f for n in kept for folders in _manifest(files, n)["parts"].values() for f in folders}
    for number in gone:
        for folder in {f for folders in _manifest(files, number)["parts"].values() for f in folders} - needed:
            files.remove(*folder.split("/"))
        files.remove(_MANIFESTS, f"{number:012d}.json")
    return gone
