"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def label_sample(labels: DataFrame, label: str, limit: int, keep: Column | None = None) -> DataFrame:
    """At most ``limit`` rows (doc_id, y) of a label table, the same ones in every run: lowest hash of the id first.

    Rows without an id or a label do not count; of several labels of one document the lowest counts.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        rows = rows.filter(keep)
    rows = rows.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
