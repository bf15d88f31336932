"""Joins against lookup tables that have one row per key.

A lookup that is small *by count* is broadcast. A larger one is joined by shuffle, and keys that hold many
fact rows are spread over several reducers: at most P keys can hold more than 1/P of all rows, so the table
of hot keys is small however large the data is, and no row is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.runtime import bounded, shuffle_parts

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 48 << 20
_SALT, _SALTS = "__salt", "__salts"


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row in memory."""
    total = F.lit(16)
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(name), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType):
            total = total + F.greatest(F.size(name), F.lit(0)) * 8 + 32
        else:
            total = total + 8
    return total


def lookup_size(lookup: DataFrame, weight: str | None = None) -> tuple[int, int, int]:
    """(rows, bytes, fact rows) of a lookup table, from one small aggregate."""
    weighed = F.sum(weight) if weight else F.lit(0)
    row = lookup.agg(F.count("*"), F.sum(_row_bytes(lookup).cast("long")), weighed).first()
    return row[0], row[1] or 0, row[2] or 0


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    weight: str,
    salt_by: Sequence[str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of ``facts`` with ``lookup`` on ``on``.

    ``weight`` names the lookup column with the number of fact rows of each key; it is not part of the result.
    ``salt_by`` are fact columns that tell rows of one key apart (default: all of them).
    """
    on = list(on)
    rows, size, total = lookup_size(lookup, weight)
    if rows <= broadcast_rows and size <= broadcast_bytes:
        return facts.join(F.broadcast(lookup.drop(weight)), on, "left")

    parts = shuffle_parts(facts.sparkSession)
    salts = (F.floor(F.coalesce(F.col(weight), F.lit(0)) * parts / F.lit(max(total, 1))) + 1).cast("int")
    salted = lookup.withColumn(_SALTS, salts)
    hot = salted.filter(F.col(_SALTS) > 1).select(*on, _SALTS)  # at most ``parts`` keys
    spread = F.pmod(F.xxhash64(*(salt_by or facts.columns)), F.lit(parts).cast("long")).cast("int")
    missing_key = F.lit(False)
    for name in on:
        missing_key = missing_key | F.col(name).isNull()
    facts = (
        facts.join(F.broadcast(hot), on, "left")
        .withColumn(
            _SALT,
            F.when(missing_key, spread).otherwise(F.pmod(spread, F.coalesce(_SALTS, F.lit(1)))),
        )
        .drop(_SALTS)
    )
    replicas = salted.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.col(_SALTS) - 1)))
    return facts.join(replicas.drop(weight, _SALTS), [*on, _SALT], "left").drop(_SALT)


def attach_cluster_label(df: DataFrame, labels: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Add the keyword label of each cluster id; an id without a label reads ``cluster_<id>``.

    ``labels`` has a row per cluster; it is broadcast if it is as small as a fitted model makes it.
    """
    named = labels.select(F.col("cluster_id").alias(cluster), F.col("label").alias("semantic_group"))
    joined = df.join(bounded(named), cluster, "left")
    default = F.concat(F.lit("cluster_"), F.col(cluster).cast("string"))
    return joined.withColumn("semantic_group", F.coalesce("semantic_group", default))
