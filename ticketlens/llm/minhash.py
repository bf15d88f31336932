"""MinHash fingerprints of documents.

A text's shingles are its distinct runs of five lower-cased words (with fewer words, all of them as one). ``PERMUTATIONS`` universal hash
functions are applied to all shingle hashes in numpy blocks; the least value of each, cut to its low ``DIGIT_BITS`` bits, is a place of
the fingerprint. The likeness of two fingerprints is the share of equal places, with the share that agrees by chance taken out.

For near duplicates bands of the full signature are joined in Spark. Documents with equal shingle sets are one class. Classes that share
a band are compared, all pairs of them, in the tiles of ``ngram_join`` by the exact Jaccard index of their shingles (64-bit hashes, words
lower-cased in A to Z); a pair at 0.8 shares no band with probability 5e-8. ``near_counts`` counts every document's near duplicates,
``near_duplicates`` lists them.

Defined results: null text is empty; a text without words has the fingerprint of no shingle (all digits at their highest), which is like
another such text (1) and unlike all others (0); equal texts have equal fingerprints; repeated rows give repeated results.
A text without words has no near duplicate; a row without an id has none and counts as none. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm import ngram_join
from ticketlens.llm.common import ascii_lower, parts, stream_map, texts_of
from ticketlens.runtime import written

SHINGLE = 5
PERMUTATIONS = 128
DIGIT_BITS = 8
BANDS, ROWS_PER_BAND = 32, 4
THRESHOLD = 0.8
_BLOCK = 4096

_rng = np.random.default_rng(12345)
_FACTOR = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_SHIFT = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, distinct."""
    words = ascii_lower(text).encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint32)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(w))):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each permutation; the highest number for no shingle."""
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[None, at : at + _BLOCK] * _FACTOR + _SHIFT).min(axis=1), out=least)
    return least


def digits(full: np.ndarray) -> np.ndarray:
    """Low bits, mixed first: the least of many values says little in its high bits."""
    mixed = full * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    return np.where(full == 0xFFFFFFFF, np.uint32(0xFF), mixed & np.uint32((1 << DIGIT_BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    none = [bool((x == 0xFF).all()) for x in (a, b)]  # the fingerprint of no shingle
    if any(none):
        return float(all(none))
    chance = 1 / (1 << DIGIT_BITS)
    same = float((a == b).mean())
    return round(max(0.0, (same - chance) / (1 - chance)), 6)


def text_key(text: str) -> int:
    """Tells texts of the same id apart."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Row:
    """A document with what is computed from it alone."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.print = digits(signature(shingle_hashes(text)))

    def result(self, following: _Row) -> tuple:
        edited = edited_text(self.text, following.text)
        new = digits(signature(shingle_hashes(edited)))
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            self.print.tobytes(), new.tobytes(), likeness(self.print, new), likeness(self.print, following.print), text_key(self.text),
        )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text_key long"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}[f.split()[1]] for f in RESULT.split(", ")]


def _batch(rows: list[tuple], extra: list[tuple]) -> pa.RecordBatch:
    """Finished rows, then edge rows (part, edge, text, doc_id)."""
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    n, m = len(rows), len(extra)
    arrays = [pa.array([*c, *([None] * m)], t) for c, t in zip(columns, _TYPES)]
    arrays[0] = pa.array([*columns[0], *[e[3] for e in extra]], pa.int64())
    for i, t in enumerate((pa.int32(), pa.string(), pa.string())):
        arrays.append(pa.array([None] * n + [e[i] for e in extra], t))
    return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "part", "edge", "edge_text"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``keyed`` without the key."""
    return keyed(docs).drop("text_key")


def keyed(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, how like they and the next document's are, and a key of the text.

    The next document has the next lower id (after the lowest comes the highest; null ids come last; rows with the same id go by text).
    Documents are range-partitioned by id, so the next one lies in the same task but for the last of each partition. Those rows, two per
    partition, are written as they are, paired with the first row of the following partition and finished in a second, small pass.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.md5("text")]
    ranged = rows.repartitionByRange(2 * parts(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            done, edges = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                row = _Row(doc_id, text)
                if last is None:
                    edges.append((part, "first", text, doc_id))
                else:
                    done.append(last.result(row))
                last = row
            yield _batch(done, edges)
        if last is not None:
            yield _batch([], [(part, "last", last.text, last.doc_id)])

    result = written(stream_map(ranged, run, f"{RESULT}, part int, edge string, edge_text string"), "fingerprints")
    inner = result.filter("edge IS NULL").select(*_NAMES)
    edges = result.filter("edge IS NOT NULL")
    firsts = edges.filter("edge = 'first'").select("part", F.col("edge_text").alias("first_text"))
    lasts = edges.filter("edge = 'last'").select("part", "doc_id", F.col("edge_text").alias("text"))
    following = Window.orderBy("part")  # one row per partition
    numbers = firsts.select("part").withColumn("_next", F.lead("part").over(following))
    numbers = numbers.withColumn("_next", F.coalesce("_next", F.min("part").over(Window.partitionBy(F.lit(0)))))
    heads = firsts.withColumnRenamed("part", "_next")
    pairs = lasts.join(F.broadcast(numbers), "part").join(heads, "_next").select("doc_id", "text", "first_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_Row(i, a).result(_Row(None, b)) for i, a, b in zip(batch.column("doc_id").to_pylist(), texts_of(batch), texts_of(batch, "first_text"))]
            columns = list(zip(*done)) if done else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    every = inner.unionByName(stream_map(pairs, finish, RESULT))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def banded(docs: DataFrame) -> DataFrame:
    """Written table, one row per document with an id and a word: doc_id, key of the text, class, number of shingles, a key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                exact = ngram_join.shingles(text, SHINGLE)
                if len(exact):
                    full = signature(shingle_hashes(text))
                    bands = [bytes([b]) + full[b * ROWS_PER_BAND : (b + 1) * ROWS_PER_BAND].tobytes() for b in range(BANDS)]
                    keys = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in bands]
                    rows.append((doc_id, text_key(text), ngram_join.set_id(exact), len(exact), keys))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "text_key", "node", "n_shingles", "keys"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return written(stream_map(known, run, "doc_id long, text_key long, node long, n_shingles long, keys array<long>"), "bands")


def _compared(docs: DataFrame, threshold: float, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their class, the classes, and what ``ngram_join.links`` finds among classes that share a band."""
    bands = banded(docs)
    classes = bands.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes, "classes")
    one = bands.groupBy("node").agg(F.first("keys").alias("keys"))  # equal sets have equal keys
    grouped = ngram_join.meeting(one.select("node", F.explode("keys").alias("key")))
    found = written(ngram_join.links(docs, classes, grouped, SHINGLE, round(100 * threshold, 6), listed), "links")
    return bands, classes, found


def near_counts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, n_near): how many other documents are near duplicates, for documents that have some."""
    bands, classes, found = _compared(docs, threshold, False)
    degrees = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    n_near = F.col("n_docs") - 1 + F.coalesce("degree", F.lit(0))
    counts = classes.join(degrees, "node", "left").select("node", n_near.cast("long").alias("n_near")).filter("n_near > 0")
    return written(bands.join(counts, "node").select("doc_id", "text_key", "n_near").distinct(), "near")


def with_near(docs: DataFrame) -> DataFrame:
    """``fingerprints`` and, for each document, the number of its near duplicates."""
    near = near_counts(docs)
    near = near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("n_near").alias("_n"))
    rows = keyed(docs)
    joined = rows.join(near, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.withColumn("n_near", F.coalesce("_n", F.lit(0))).drop("_id", "_key", "_n", "text_key")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, leader, jaccard) of near duplicates: every document with the smallest id of those with equal shingles, and all pairs
    of such smallest ids, each once with the smaller as leader. So exact copies stay linear, near copies are all listed."""
    bands, classes, found = _compared(docs, threshold, True)
    reps = classes.select("node", "rep", "n_shingles")
    copies = bands.join(reps.drop("n_shingles"), "node").filter("doc_id <> rep").select("doc_id", F.col("rep").alias("leader"), F.lit(1.0).alias("jaccard")).distinct()
    a, b = (reps.toDF(c, f"{c}_rep", f"{c}_size") for c in ("a", "b"))
    pairs = found.join(a, "a").join(b, "b").filter("a_rep <> b_rep")
    jaccard = F.col("n") / (F.col("a_size") + F.col("b_size") - F.col("n"))
    return copies.unionByName(pairs.select(F.greatest("a_rep", "b_rep").alias("doc_id"), F.least("a_rep", "b_rep").alias("leader"), jaccard.alias("jaccard")))
