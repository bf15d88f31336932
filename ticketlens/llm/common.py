"""What the document operators share: input columns, the word rule, batches of Arrow rows, ranks without a global sort."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.runtime import ship_package, shuffle_parts

#: A word is a run of anything but space and U+0009 to U+000D; for bytes this is what ``bytes.split()`` does.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to each Arrow batch of ``df``; it may return None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return stream_map(df, run, schema)


def stream_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def ascii_lower(text: str) -> str:
    """A-Z to lower case and nothing else, so that positions stay."""
    return text if text.isascii() and text.islower() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def running_totals(df: DataFrame, groups: list[str], key: str, measures: dict[str, Column], tie: list[str]) -> DataFrame:
    """Add, for each name in ``measures``, the sum of that measure over the rows of the group that come before by ``key``.

    ``key`` is a column of hexadecimal digits whose values are spread evenly (a hash). Rows of one group are first cut into
    buckets by the key's first three digits; totals of the buckets are added up, then the rows of each bucket. So no group is
    sorted in one task, however large it is. Rows with the same key go by ``tie``.
    """
    bucket = F.conv(F.substring(F.col(key), 1, 3), 16, 10).cast("int")
    rows = df.withColumn("_bucket", bucket)
    for name, measure in measures.items():
        rows = rows.withColumn(f"_m_{name}", measure)
    totals = rows.groupBy(*groups, "_bucket").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in measures],
    )
    same = F.col("_bucket") == F.col("_b")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(key, *tie).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(base, same)
    for n in measures:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(f"_m_{n}").over(within), F.lit(0)))
    return out.select(*df.columns, *measures)


def parts(spark: SparkSession) -> int:
    return shuffle_parts(spark)
