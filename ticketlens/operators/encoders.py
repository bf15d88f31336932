"""Text encoders: a fitted encoder adds an ``embedding`` column to a table with a text column.

An embedding is an ML vector, sparse where most places are 0 so that it costs what the text has terms, or an ``array<float>`` from encoders
that have it so; clustering, projection and saving take both. Any object with ``encode(df, text) -> df + embedding`` and ``save(path)`` is an encoder. Encoders are fitted on
a dictionary of distinct texts, so a text that stands on a billion rows is encoded once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.text import normalize_text
from ticketlens.operators.joins import lookup_join
from ticketlens.runtime import written
from ticketlens.sources.tables import read_table, write_table

EMBEDDING = "embedding"
_TERMS, _RAW, _WEIGHED, _UNIT = "__terms", "__raw", "__weighed", "__unit"
# What a place of a text begins: three characters of a word, or a whole word that has fewer.
_TRIPLE = "(?=([a-z0-9]{3}|(?<![a-z0-9])[a-z0-9]{1,2}(?![a-z0-9])))"


def word_and_trigram_terms(text: str | Column) -> Column:
    """Accent-free words and the letter triples inside them, so that related word forms share terms."""
    plain = F.lower(normalize_text(text))
    words = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    triples = F.regexp_extract_all(plain, F.lit(_TRIPLE), F.lit(1))
    return F.concat(words, F.transform(triples, lambda t: F.concat(F.lit("#"), t)))


@dataclass(frozen=True)
class MlEncoder:
    """Terms of a text through fitted Spark ML stages; works row by row, so on streams too."""

    stages: PipelineModel

    def encode(self, df: DataFrame, text: str) -> DataFrame:
        with_terms = df.withColumn(_TERMS, word_and_trigram_terms(F.coalesce(F.col(text), F.lit(""))))
        out = self.stages.transform(with_terms)
        return out.select(*df.columns, F.col(_UNIT).alias(EMBEDDING))

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "MlEncoder":
        return MlEncoder(PipelineModel.load(path))


def fit_hashed_tfidf(dictionary: DataFrame, text: str = "text", size: int = 2_048) -> MlEncoder:
    """Hashed term frequencies, weighted by rarity, at unit length, as sparse vectors.

    Terms share ``size`` places; with a large vocabulary give a larger one (``partial(fit_hashed_tfidf, size=...)``).
    """
    hashed, rarity, unit = _hashed_stages(size)
    fitted = rarity.fit(hashed.transform(dictionary.select(word_and_trigram_terms(text).alias(_TERMS))))
    return MlEncoder(PipelineModel([hashed, fitted, unit]))


def fit_encode_hashed_tfidf(dictionary: DataFrame, text: str = "text", size: int = 2_048) -> tuple[MlEncoder, DataFrame]:
    """``fit_hashed_tfidf`` and what it encodes the dictionary to, from one reading of its texts: for whole documents.

    The term frequencies, which take a few bits each, are written and serve both; weights at full width are not.
    """
    hashed, rarity, unit = _hashed_stages(size)
    terms = dictionary.withColumn(_TERMS, word_and_trigram_terms(text))
    raw = written(hashed.transform(terms).drop(_TERMS), "frequencies", "zstd")
    fitted = rarity.fit(raw)
    encoded = unit.transform(fitted.transform(raw)).select(*dictionary.columns, F.col(_UNIT).alias(EMBEDDING))
    return MlEncoder(PipelineModel([hashed, fitted, unit])), encoded


def _hashed_stages(size: int) -> tuple[HashingTF, IDF, Normalizer]:
    return (
        HashingTF(inputCol=_TERMS, outputCol=_RAW, numFeatures=size),
        IDF(inputCol=_RAW, outputCol=_WEIGHED),
        Normalizer(inputCol=_WEIGHED, outputCol=_UNIT),
    )


def fit_word2vec(dictionary: DataFrame, text: str = "text", size: int = 64, seed: int = 42) -> MlEncoder:
    """Mean of learned term vectors, at unit length."""
    stages = Pipeline(
        stages=[
            Word2Vec(inputCol=_TERMS, outputCol=_RAW, vectorSize=size, minCount=1, seed=seed),
            Normalizer(inputCol=_RAW, outputCol=_UNIT),
        ]
    )
    return MlEncoder(stages.fit(dictionary.select(word_and_trigram_terms(text).alias(_TERMS))))


@dataclass(frozen=True)
class TableEncoder:
    """Precomputed embeddings, (text, embedding) with a row per text. An unknown text has no embedding.

    Texts are counted before they are joined, so that a text of very many rows is spread over several tasks.
    """

    table: DataFrame

    def encode(self, df: DataFrame, text: str) -> DataFrame:
        counts = df.groupBy(text).agg(F.count("*").alias("__weight"))
        keyed = self.table.select(F.col("text").alias(text), EMBEDDING).join(counts, text)
        return lookup_join(df, keyed, [text], "__weight").select(*df.columns, EMBEDDING)

    def save(self, path: str) -> None:
        write_table(self.table.select("text", EMBEDDING), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TableEncoder":
        return TableEncoder(read_table(spark, path))


@dataclass(frozen=True)
class BatchEncoder:
    """Any local encoder: ``make`` returns a function from a batch of texts to a matrix, once per worker.

    Code is not stored with a model: give the encoder again to ``load_semantics``.
    """

    make: Callable[[], Callable]
    batch_size: int = 32

    def encode(self, df: DataFrame, text: str) -> DataFrame:
        batch = predict_batch_udf(self.make, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size)
        plain = vector_to_array(array_to_vector(batch(F.col(text))), "float32")  # elements are never null, as clustering asks
        return df.withColumn(EMBEDDING, plain)


def save_encoder(encoder, spark: SparkSession, path: str) -> None:
    if not isinstance(encoder, BatchEncoder):
        encoder.save(f"{path}/encoder")
    kind = json.dumps({"kind": type(encoder).__name__})
    spark.createDataFrame([(kind,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/encoder_kind")


def load_encoder(spark: SparkSession, path: str, given=None):
    """The stored encoder; ``given`` is used for one that holds code."""
    kind = json.loads(spark.read.text(f"{path}/encoder_kind").first().value)["kind"]
    if kind == "BatchEncoder":
        if given is None:
            raise ValueError("this model was fitted with a batch encoder: give it again")
        return given
    return MlEncoder.load(f"{path}/encoder") if kind == "MlEncoder" else TableEncoder.load(spark, f"{path}/encoder")
