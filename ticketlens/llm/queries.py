"""Registered queries: each applies one operator, with its production parameters, to the whole ``documents`` or ``embeddings`` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import classifier, exact_dedup, language, minhash, mixing, negatives, ngram_join, packing, rules, secrets, sharding, suffix_dedup, whitening
from ticketlens.llm.common import table
from ticketlens.runtime import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N_SHARDS = 24


def query(key: str, sql: str | None = None):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op2_hypergeometric_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.digest(table(spark, sf_dir, "documents"))
    dealt = sharding.shard(rows, ["doc_id", "size", "text_crc32"], N_SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


@query("op3_zstd_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(spark, sf_dir)


@query("op4_decision_list")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = written(rules.text_statistics(table(spark, sf_dir, "documents")), "statistics")
    learned = rules.fit(statistics, table(spark, sf_dir, "labels"))
    return rules.judged(statistics, learned).select("doc_id", *rules.COUNTS, "base_failed", "kept", "rule")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (SELECT CAST(sum(source_size) AS BIGINT) FROM s) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
c AS (SELECT *, weight * (total - capped_before) >= cap * rest AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
  FROM c),
b AS (
  SELECT d.*, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM b)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""


def _place(epoch: str) -> str:
    share = f"(({epoch} * source_size + before) / target)"
    root = f"sqrt(w_start * w_start + (w_end * w_end - w_start * w_start) * {share})"
    return f"CASE WHEN copies > 0 THEN CASE WHEN {share} <= 0 THEN 0 ELSE (w_start + w_end) * {share} / (w_start + {root}) END END"


#: The mix with the training positions of each document's first and last copy.
POSITIONS_SQL = (
    MIX_SQL[: MIX_SQL.rindex("\nSELECT doc_id")]
    + """,
f AS (
  SELECT e.*, CAST([0.5, 2.0, 4.5][CAST(weight AS INT)] AS DOUBLE) AS w_start, CAST([1.5, 2.0, 1.5][CAST(weight AS INT)] AS DOUBLE) AS w_end,
    epochs + CASE WHEN before < CAST(floor(e.target) AS BIGINT) - epochs * e.source_size THEN 1 ELSE 0 END AS copies
  FROM e JOIN w ON e.source IS NOT DISTINCT FROM w.source)"""
    + MIX_SQL[MIX_SQL.rindex("\nSELECT doc_id") :].replace(
        " AS taken\nFROM e", f" AS taken,\n  {_place('0')} AS first_position,\n  {_place('(copies - 1)')} AS last_position\nFROM f"
    )
)


@query("op5_curriculum_mix", POSITIONS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.trained_on(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


@query("op7_ftrl_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(spark, sf_dir)


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


@query("op9_concatenate_and_cut")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_minhash_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_near(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, text_sha256,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""


@query("op11_exact_dedup", EXACT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest_first = -F.coalesce(F.length("text"), F.lit(0))
    return exact_dedup.copies(table(spark, sf_dir, "documents"), longest_first)


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, label, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM r),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(sum(a.v * b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.i = b.i WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 50 == 0)
