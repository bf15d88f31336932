"""Folders that are published whole: a reader finds the last complete version or an error, never half of one.

    <path>/versions/<name>/...   the files of a version, never changed afterwards
    <path>/manifest/             a one-row file per complete version: its number, name, and its files with sizes and checksums

A version's manifest row is written last, as one file, which appears at once or not at all. A writer that dies leaves files that no manifest
names; the version before it stays the current one. Older versions stay too, for readers that still hold them; remove them when none does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "version long, name string, files array<struct<file: string, bytes: long, md5: string>>"


class NotPublished(ValueError):
    """Nothing complete was published at this path."""


class Damaged(ValueError):
    """Files of a published version are missing or differ from its manifest."""


def _entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_ENTRY).json(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def _files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, bytes, md5) of all files of a version, read where they lie."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/versions/{name}")
    return found.select(
        F.substring_index("path", f"/versions/{name}/", -1).alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5")
    )


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, name, files, bytes) of what was published; two writers at once may share a number, then the name decides which is later."""
    sizes = F.transform("files", lambda f: f["bytes"])
    return _entries(spark, path).select(
        "version", "name", F.size("files").alias("files"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("bytes")
    )


def publish(spark: SparkSession, path: str, write: Callable[[str], object]) -> int:
    """Let ``write`` fill the folder it is given, then publish it as the next version; its number."""
    path = path.rstrip("/")
    name = uuid.uuid4().hex
    write(f"{path}/versions/{name}")
    number = (_entries(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    whole = _files(spark, path, name).agg(F.array_sort(F.collect_list(F.struct("file", "bytes", "md5"))).alias("files"))
    entry = whole.select(F.lit(number).cast("long").alias("version"), F.lit(name).alias("name"), "files")
    entry.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def current(spark: SparkSession, path: str, check: bool = True) -> str:
    """The folder of the last version; ``check`` compares all its files with the manifest first."""
    path = path.rstrip("/")
    entry = _entries(spark, path).orderBy(F.desc("version"), F.desc("name")).first()
    if entry is None:
        raise NotPublished(f"nothing was published at {path}")
    if check:
        wanted = {(f.file, f.bytes, f.md5) for f in entry.files}
        try:
            found = {(f.file, f.bytes, f.md5) for f in _files(spark, path, entry.name).collect()}  # a row per file of one model
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = set()
        wrong = sorted(f[0] for f in wanted - found)
        if wrong:
            raise Damaged(f"{len(wrong)} files of version {entry.version} at {path} are missing or changed, first {wrong[0]}")
    return f"{path}/versions/{entry.name}"
