"""Reading and writing of tables: tickets, splits, features, metrics, importances, cluster labels."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import params

log = logging.getLogger(__name__)

# Timestamps keep their microseconds in text files.
_CSV_OPTIONS = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_SUFFIXES = {"parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc"}


def format_of(path: str) -> str:
    """Format by file suffix; a path without a known suffix is a Parquet folder."""
    return _SUFFIXES.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null from here on: Spark orders NaN above every number, the label rules must not see it."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns]
    )


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Read a table by suffix (or by the given format) with an explicit schema; NaN becomes null."""
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("a CSV table needs a schema")
    if fmt == "csv":
        reader = reader.options(**_CSV_OPTIONS)
    return nan_to_null(reader.load(path))


def write_table(
    df: DataFrame, path: str, fmt: str | None = None, partition_by: Iterable[str] = (), mode: str = "overwrite"
) -> str:
    fmt = fmt or format_of(path)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(**_CSV_OPTIONS)
    by = list(partition_by)
    (writer.partitionBy(*by) if by else writer).save(path)
    return path


def write_splits(df: DataFrame, path: str) -> str:
    """All splits as one table, a folder for each split."""
    return write_table(df, path, "parquet", partition_by=["split"])


def read_splits(spark: SparkSession, path: str, splits: Iterable[str] | None = None) -> DataFrame:
    """The split table, or some splits of it; the filter on the partition column prunes folders. Names stay text, also ``01``."""
    found = spark.read.parquet(path).schema
    kept = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "split" else f for f in found.fields])
    df = nan_to_null(spark.read.schema(kept).parquet(path))
    wanted = list(splits) if splits is not None else None
    return df if wanted is None else df.filter(F.col("split").isin(wanted))


def check_splits(df: DataFrame) -> list[str]:
    """The usual splits that the table holds. A missing train split is an error, other missing ones a warning."""
    found = df.agg(*[F.bool_or(F.col("split") == name).alias(name) for name in params.SPLITS]).first()
    if not found["train"]:
        raise ValueError("the table has no train split")
    for name in params.SPLITS:
        if not found[name]:
            log.warning("split %s is missing and is skipped", name)
    return [name for name in params.SPLITS if found[name]]


def splits_present(df: DataFrame) -> DataFrame:
    """(split, rows) for every split the table holds, whatever its name and however many there are."""
    check_splits(df)
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def write_importances(importances: DataFrame, path: str, fmt: str | None = None) -> str:
    """Importance table, highest first. One row per model input, so one sorted file."""
    ordered = importances.orderBy(F.desc("importance"), "feature").coalesce(1)
    return write_table(ordered, path, fmt)


def cluster_json(dictionary: DataFrame) -> DataFrame:
    """One row per text level: the cluster dictionary as a single JSON object ``{id: label}``."""
    entries = F.sort_array(F.collect_list(F.struct("cluster_id", "label")))
    as_map = F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["cluster_id"].cast("string").alias("key"), e["label"].alias("value")))
    )
    return dictionary.groupBy("tab").agg(F.to_json(as_map).alias("clusters"))


def write_cluster_json(dictionary: DataFrame, path: str) -> str:
    """One JSON record per cluster, a folder per text level."""
    return write_table(dictionary, path, "json", partition_by=["tab"])
