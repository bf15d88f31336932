"""A training corpus from ``documents`` in five stages, each on all that its predecessor kept.

1. quality classifier: documents scored below one half go.
2. n-gram Jaccard join: of documents linked at 0.8 on five-word shingles, directly or through others, the smallest id stays.
3. secret scan: secrets are replaced by their kind; no document goes.
4. mixing: each source is taken, whole documents once or several times, up to its target, in the order of the curriculum.
5. packing: the token stream cut into sequences; one row per piece.

All stages but the last return the columns of ``documents``. Rows with a null text, id or source go through all stages as others do; stage 4
leaves out what its targets leave out, and documents without words of a source that has no words at all. A row that
repeats the id of another one counts as its copy in stage 2.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import classifier, mixing, ngram_join, packing, secrets
from ticketlens.llm.common import table
from ticketlens.runtime import written

SHINGLE, PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(docs, weights, "_chance_of_good").filter(F.col("_chance_of_good") >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = written(ngram_join.join(docs, SHINGLE, PERCENT), "classes")
    later = joined.filter("doc_id <> component_id").select("doc_id")
    repeated = joined.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    kept = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    if not repeated.take(1):
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.coalesce(F.md5("text"), F.lit("")), F.md5(F.to_json(whole)))
    several = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias("_row"))  # copies fall together in each task
    return single.unionByName(several.select("_row.*"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", scan_secrets),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: No SQL: the classifier is trained and the tokenizer is a library; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
