"""Exact dedup: rows are grouped by a 128-bit hash of their text, bytes decide inside a group, the smallest stable id stays.

The hash leads the grouping, the text follows it as a second key: rows of one hash are compared byte by byte, and texts that only share
the hash are groups of their own. Copies fall together in each task before anything is shuffled, so a group of a third of all rows
arrives as one row per task. Rows without their text then fetch their group's result by the hash and, as a label of the text, its SHA-256;
groups that hold many rows are spread over several tasks by their counted size. DataFrame functions only.

Which row stays: the smallest ``rank`` (an argument), then the smallest id, rows without an id last, then the row that was read first.
Defined results: null text is empty, and empty texts are equal; of rows that repeat an id and a text exactly one stays; a group whose rows
have no id has a null ``keep_id``; other columns of the input are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.operators.joins import lookup_join
from ticketlens.runtime import written

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def without_white_space(text: Column) -> Column:
    """The text without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _order(rank: Column, doc_id: Column) -> list[Column]:
    return [rank.alias("rank"), doc_id.isNull().alias("without"), doc_id.alias("id")]


def copies(
    docs: DataFrame,
    rank: Column | None = None,
    normalise: Callable[[Column], Column] = without_white_space,
    content_hash: Callable[[Column], Column] = md5_bytes,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``, ``text_sha256``."""
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (F.lit(0) if rank is None else rank).alias("_rank"),
        normalise(F.col(text)).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = rows.withColumn("_hash", content_hash(F.col("_text"))).withColumn("_label", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    rows = written(rows, "normalised")  # row numbers stay as they are from here on
    best = F.min(F.struct(*_order(F.col("_rank"), F.col("_id")), F.col("_row").alias("row"))).alias("_best")
    groups = rows.groupBy("_hash", "_text").agg(F.first("_label").alias("_label"), F.count(F.lit(1)).alias("_rows"), best)
    groups = groups.select("_hash", "_label", "_rows", F.col("_best.id").alias("keep_id"), F.col("_best.row").alias("_kept_row"))
    groups = written(groups.withColumn("group_size", F.col("_rows")), "groups")
    out = lookup_join(rows.drop("_text", "_rank"), groups, ["_hash", "_label"], "_rows", ["_row"])
    return out.select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("_row") == F.col("_kept_row")).alias("kept"),
        F.lower(F.hex("_label")).alias("text_sha256"),
    )


def deduplicated(
    docs: DataFrame,
    rank: Column | None = None,
    normalise: Callable[[Column], Column] = without_white_space,
    content_hash: Callable[[Column], Column] = md5_bytes,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of rows that repeat an id and a text the one with the least content hash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(*_order(F.lit(0) if rank is None else rank, F.col(id_column)), F.md5(F.to_json(whole)).alias("content"))
    rows = docs.select(whole.alias("_whole"), order.alias("_order"), normalise(F.col(text)).alias("_text"))
    kept = rows.withColumn("_hash", content_hash(F.col("_text"))).groupBy("_hash", "_text").agg(F.min_by("_whole", "_order").alias("_whole"))
    return kept.select("_whole.*")
