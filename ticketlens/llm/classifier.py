"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text: words and word pairs; the same for word shapes (letter case, digits and signs, runs collapsed), so that words never
seen still tell; a mark where a word repeats the one before. Each is hashed into ``2 ** BITS`` weights, valued count / sqrt(all counts);
a score is one sparse dot product, computed as a sum of weights over the text's hashes.

Training reads at most ``FIT_ROWS`` labelled documents. They are dealt to ``SHARDS`` tasks, each runs ``EPOCHS`` of per-coordinate updates,
and the models are averaged (parameter mixing), so no task or driver holds more than its share of the bounded sample. Only the averaged
weights, ``2 ** BITS`` numbers, are sent to the executors.

Defined results: a text without words scores by the bias alone; without a label of each class, all score the share of label 1 (0.5
without labels); equal texts score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import arrow_map, stream_map, table, texts_of
from ticketlens.llm.labelled import crc_of_id, label_sample
from ticketlens.runtime import written

BITS = 18
FIT_ROWS = 20_000
SHARDS = 4
EPOCHS = 3
#: Learning rate and its smoothing, weight of the absolute and of the squared penalty.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_SHAPES = bytes.maketrans(
    bytes(range(256)),
    bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)),
)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)


def shapes(data: bytes) -> list[bytes]:
    """Shape of each word, runs collapsed: ``ABC-12`` is ``A-0``."""
    letters = np.frombuffer(data.translate(_SHAPES), np.uint8)
    if not len(letters):
        return []
    keep = np.ones(len(letters), bool)
    keep[1:] = letters[1:] != letters[:-1]
    return letters[keep].tobytes().split()


def features(text: str) -> np.ndarray:
    """Hashed features of a text, one entry per occurrence."""
    data = text.encode("utf-8", "surrogatepass")
    words = _hashes(data.split())
    if not len(words):
        return np.empty(0, np.uint32)
    shape = _hashes(shapes(data))
    pairs = words[:-1] * np.uint32(31) + words[1:]
    shape_pairs = shape[:-1] * np.uint32(31) + shape[1:]
    same = np.full(int((words[1:] == words[:-1]).sum()), 1, np.uint32)
    return np.concatenate([_mixed(words, 1), _mixed(pairs, 2), _mixed(shape, 3), _mixed(shape_pairs, 4), _mixed(same, 5)])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _vector(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(hashes, return_counts=True)
    x = count / np.sqrt(max(1, len(hashes)))
    return np.append(at, 1 << BITS).astype(np.int64), np.append(x, 1.0)


def train(docs: DataFrame, sample: DataFrame, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged weights, bias last. ``sample``: doc_id and y of a bounded number of documents."""
    spark = docs.sparkSession
    sample = written(sample, "sample")
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(size) < 2:
        share = 0.5 if not size else min(0.999, max(0.001, float(next(iter(size)))))
        return np.append(np.zeros(1 << BITS), np.log(share / (1 - share)))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), F.col("_id") == F.col("doc_id"))
    key = F.md5(F.col("doc_id").cast("string"))
    rows = rows.select(F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard"), key.alias("key"), "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, y, text in zip(batch.column("shard").to_pylist(), batch.column("y").to_pylist(), texts_of(batch)):
                at, x = _vector(features(text))
                held.setdefault(shard, []).append((at.astype(np.int32), x.astype(np.float32), y))
        for rows_ in held.values():
            model = Ftrl(1 << BITS)
            for _ in range(epochs):
                for at, x, y in rows_:
                    model.learn(at, x, y)
            w = model.weights(np.arange((1 << BITS) + 1))
            used = np.flatnonzero(w)
            at = np.append(used, -1).astype(np.int32)  # a row at -1 counts the models
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(w[used], 1.0))], ["at", "w"])

    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", F.md5("text"))
    models = written(stream_map(dealt, run, "at int, w double"), "models")
    total = models.groupBy("at").agg(F.sum("w").alias("w")).toPandas()  # at most 2 ** BITS + 2 rows
    out = np.zeros((1 << BITS) + 2)
    out[total["at"].to_numpy()] = total["w"].to_numpy()
    return np.round(out[:-1] / max(1.0, out[-1]), 9)  # sums of a few models in any order


def fit(docs: DataFrame, labels: DataFrame, held_in=None, limit: int = FIT_ROWS) -> np.ndarray:
    return train(docs, label_sample(labels, "quality", limit, held_in))


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """Columns of ``docs`` and the chance of label 1 as ``name``; a column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        raw = []
        for text in texts_of(batch):
            h = features(text)
            raw.append(float(w[-1]) + (float(w[h].sum(dtype=np.float64)) / np.sqrt(len(h)) if len(h) else 0.0))
        score = 1 / (1 + np.exp(-np.clip(np.array(raw), -35, 35)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 6))], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, `{name}` double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(3)) == 1


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learned only from rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = scored(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
