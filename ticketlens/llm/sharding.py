"""Uniform sharding with exact shard sizes: hypergeometric communication matrix.

Rows lie in logical partitions. How many rows of each partition go to each shard is drawn exactly (multivariate hypergeometric, one
partition after another from what the shards still take); each partition deals its rows out in a random local order, and each shard puts
what it gets into a new random order. Every assignment with these shard sizes is then equally likely.

The matrix has ``PARTITIONS`` x ``n_shards`` numbers, whatever the data: partitions are hash buckets of the rows, so their rows grow, not
their number, and reruns on any layout of the files agree. All random orders are hashes with a seed.

Defined results: null text has size 8 and the checksum of the empty text; repeated rows take a slot each; equal rows are exchangeable;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ticketlens.llm.common import running_totals
from ticketlens.runtime import local_table

PARTITIONS = 1024
#: Largest population that the library's sampler takes.
_LIBRARY_LIMIT = 1_000_000_000


def _log_mass(k: int, good: int, bad: int, sample: int) -> float:
    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    return choose(good, k) + choose(bad, sample - k)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are good; beyond the library's limit by rejection under a Laplace envelope."""
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if good + bad < _LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    mode = min(high, max(low, int((sample + 1) * (good + 1) // (good + bad + 2))))
    share = good / (good + bad)
    scale = math.sqrt(sample * share * (1 - share) * max(1e-12, 1 - (sample - 1) / (good + bad))) + 1.0
    peak = _log_mass(mode, good, bad, sample)
    while True:  # proposals: two-sided geometric around the mode; the mass is below exp(1 - distance / scale) times its peak
        step, minus = int(rng.exponential(scale)), rng.random() < 0.5
        k = mode - step if minus else mode + step
        if low <= k <= high and not (minus and step == 0):
            accept = _log_mass(k, good, bad, sample) - peak - 1.0 + step / scale
            if math.log(1.0 - rng.random()) < accept:
                return k


def communication_matrix(counts: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of partition i for shard j; row sums are ``counts``, column sums ``shard_sizes``."""
    rng = np.random.default_rng(seed)
    left, matrix = list(shard_sizes), []
    for n in counts:
        row, need, total = [], n, sum(left)
        for j, take in enumerate(left):
            got = hypergeometric(rng, take, total - take, need) if need else 0
            row.append(got)
            need, total = need - got, total - take
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def equal_sizes(n: int, n_shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [n // n_shards + (1 if j < n % n_shards else 0) for j in range(n_shards)]


def shard(rows: DataFrame, keys: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``shard`` and a gapless ``slot`` in it. ``keys`` tell rows apart; all other columns travel along."""
    spark = rows.sparkSession
    text_keys = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]

    def order(step: int):
        return F.md5(F.concat_ws("\1", *text_keys, F.lit(f"{seed}:{step}")))

    rows = rows.withColumn("_deal", order(1)).withColumn("_mix", order(2))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*text_keys), F.lit(PARTITIONS)).cast("int"))
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most PARTITIONS rows
    numbers = sorted(counts)
    matrix = communication_matrix([counts[p] for p in numbers], equal_sizes(sum(counts.values()), n_shards), seed)
    cells = []
    for p, row in zip(numbers, matrix):
        ends = np.cumsum(row).tolist()
        cells.append((p, ends))
    schema = T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))])
    ends = F.broadcast(local_table(spark, cells, schema))
    local = Window.partitionBy("_part").orderBy("_deal", *keys)
    dealt = rows.withColumn("_at", F.row_number().over(local) - 1).join(ends, F.col("_part") == F.col("_p"))
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))).cast("int"))
    dealt = dealt.drop("_deal", "_part", "_p", "_at", "_ends")
    slotted = running_totals(dealt, ["shard"], "_mix", {"slot": F.lit(1).cast("long")}, keys)
    return slotted.drop("_mix")


def write_shards(rows: DataFrame, path: str) -> None:
    """Store sharded rows, a folder per shard, each in slot order within its files."""
    rows.repartition(F.col("shard"), F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
