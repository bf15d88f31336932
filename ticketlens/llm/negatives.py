"""Hard-negative mining by a secondary-sort shuffle.

Scores travel under packed keys (anchor, score descending, kind, id). ``repartitionAndSortWithinPartitions`` deals them by anchor and sorts
them by the whole key, so a task reads an anchor's scores from the highest down: a positive opens its window, a negative is emitted to the
windows it lies in, a window closes when it is full. A task remembers the open windows of one anchor and nothing else.

Which scores travel. The anchors are a set of queries held against all rows in blocks: rows are dealt into blocks of bounded size, each
block is held as one matrix and the anchors stream past it. Of a block only what can win is sent on: first the block's best rows of the
anchor's label, which give the positives and with them the windows; then, for every window, the block's first negatives inside it. The
winners are always among these, so nothing is lost, and a block sends a bounded number of scores per anchor however many rows share a
label or a vector. The work grows with anchors times rows; only products of matrices are done for all of these.

A score is the integer inner product of vectors with entries floor(scale * c); ties go by the smaller id.
Defined results: a row with a null id or label, a null or empty vector, or a null or non-finite entry takes no part, nor one with an entry
beyond 2^26 after scaling (scores stay within 64 bits) or with another length than the commonest (the longer at a tie); of rows that repeat an
id the one with the smallest label, then vector, counts; an anchor without positives, or a window without negatives, gives no row; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import parts, stream_map
from ticketlens.llm.whitening import finite_vector
from ticketlens.runtime import ship_package, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative counts where low <= 100 * its score / the positive's score <= high.
LOW, HIGH = 50, 95
LARGEST = 1 << 26
BLOCK_ROWS, LEAST_BLOCK_ROWS = 32_768, 2_048
_ANCHORS_AT_ONCE = 128
_SIGN, _ALL = 1 << 63, (1 << 64) - 1
_KEY = struct.Struct(">QQBQ")
_POSITIVE, _NEGATIVE = 0, 1


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Key whose order as bytes is anchor, score descending, positives first, id."""
    return _KEY.pack(anchor + _SIGN, _ALL - (score + _SIGN), kind, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _SIGN, _ALL - score - _SIGN, kind, row - _SIGN


def _by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def secondary_sorted(keys: RDD, tasks: int) -> RDD:
    """Packed keys dealt by anchor; each task reads its anchors one after another, scores from the highest down."""
    return keys.map(lambda key: (key, None)).repartitionAndSortWithinPartitions(tasks, _by_anchor).keys()


def first_positives(keys: Iterator[bytes], count: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, score, id) of each anchor's first ``count`` keys."""
    for anchor, own in groupby(keys, key=lambda key: key[:8]):
        for _, key in zip(range(count), own):
            anchor, score, _, row = unpack(key)
            yield anchor, score, row


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest negative score of a positive's window; the least is above the greatest where the window is empty."""
    return -(-low * score // 100), high * score // 100


def emitted(keys: Iterator[bytes], count: int, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from keys in their order."""
    at, opened = None, []  # [positive, score, least, greatest, emitted so far] of the windows that are open
    for key in keys:
        anchor, score, kind, row = unpack(key)
        if anchor != at:
            at, opened = anchor, []
        if kind == _POSITIVE:
            opened.append([row, score, *window(score, low, high), 0])
            continue
        still = []
        for w in opened:
            if score < w[2]:
                continue  # all that follows is lower
            if score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], row, w[1], score
            if w[4] < count:
                still.append(w)
        opened = still


def integer_rows(rows: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, q) of the rows that take part, a row per id, written."""
    scaled = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = rows.filter(finite_vector(F.col(vector)) & F.col(id_column).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("_q"))
    rows = rows.filter(F.forall("_q", lambda c: F.abs(c) <= float(LARGEST)))
    rows = rows.select("id", F.struct("label", F.transform("_q", lambda c: c.cast("int")).alias("q")).alias("_row"))
    found = written(rows.groupBy("id").agg(F.min("_row").alias("_row")).select("id", "_row.label", "_row.q"), "rows")
    length = found.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.filter(F.size("q") == (length.d if length else 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.int64)


class _Block:
    """The rows of a block by id, as one matrix."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).sort_by("id")
        self.ids = table["id"].to_numpy()
        self.labels = table["label"].to_numpy()
        q = _matrix(table["q"].combine_chunks())
        self.largest = int(np.abs(q).max())
        self.whole, self.doubles = q, q.astype(float)
        order = np.argsort(self.labels, kind="stable")
        ends = np.flatnonzero(np.r_[self.labels[order][1:] != self.labels[order][:-1], True]) + 1
        self.of_label = {int(self.labels[order[e - 1]]): order[b:e] for b, e in zip(np.r_[0, ends[:-1]], ends)}

    def scores(self, queries: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Exact inner products: in doubles where these hold every sum, else in integers."""
        if self.largest * int(np.abs(queries).max()) * queries.shape[1] < 2**53:
            return (queries.astype(float) @ self.doubles[rows].T).astype(np.int64)
        return queries @ self.whole[rows].T


def _best_of_label(block: _Block, batch: pa.RecordBatch, count: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, score, id): the block's first rows of each anchor's label, the anchor left out."""
    ids, labels, queries = batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("q"))
    for label in np.unique(labels):
        rows = block.of_label.get(int(label))
        if rows is None:
            continue
        own = np.flatnonzero(labels == label)
        for begin in range(0, len(own), _ANCHORS_AT_ONCE):
            some = own[begin : begin + _ANCHORS_AT_ONCE]
            scores = block.scores(queries[some], rows)
            bounds = np.partition(scores, -(count + 1), axis=1)[:, -(count + 1)] if len(rows) > count + 1 else scores.min(1)
            for k, anchor in enumerate(some):
                near = np.flatnonzero(scores[k] >= bounds[k])  # the best and all that tie with the last of them
                near = near[block.ids[rows[near]] != ids[anchor]]
                for c in near[np.argsort(-scores[k][near], kind="stable")][:count]:
                    yield int(ids[anchor]), int(scores[k][c]), int(block.ids[rows[c]])


def _first_in_windows(block: _Block, batch: pa.RecordBatch, count: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, score, id): the block's first rows of another label inside each window of an anchor."""
    ids, labels, queries = batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("q"))
    opened = [[w for w in dict.fromkeys(window(s, low, high) for s in scores) if w[0] <= w[1]] for scores in batch.column("scores").to_pylist()]
    for begin in range(0, len(ids), _ANCHORS_AT_ONCE):
        scores = block.scores(queries[begin : begin + _ANCHORS_AT_ONCE])
        for k, row in enumerate(scores):
            at = begin + k
            if not opened[at]:
                continue
            least, most = min(w[0] for w in opened[at]), max(w[1] for w in opened[at])
            inside = np.flatnonzero((row >= least) & (row <= most) & (block.labels != labels[at]))
            inside = inside[np.argsort(-row[inside], kind="stable")]
            falling = -row[inside]
            won = set()
            for lowest, highest in opened[at]:
                first = np.searchsorted(falling, -highest, "left")
                last = min(first + count, np.searchsorted(falling, -lowest, "right"))
                won.update(inside[first:last].tolist())
            for c in won:
                yield int(ids[at]), int(row[c]), int(block.ids[c])


def against_blocks(rows: DataFrame, anchors: DataFrame, search) -> DataFrame:
    """(anchor, score, id) of what ``search(block, batch of anchors)`` finds in each block of ``rows``; a block is dealt to one task.

    ``rows`` (id, label, q) and ``anchors`` (also ``scores``) are written tables. A block's rows come before the anchors that pass it.
    """
    spark = rows.sparkSession
    count = rows.count()
    wanted = min(spark.sparkContext.defaultParallelism, -(-count // LEAST_BLOCK_ROWS))
    blocks = max(1, -(-count // BLOCK_ROWS), wanted)
    at = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")).cast("int")
    held = rows.select(at.alias("block"), F.lit(0).alias("kind"), "id", "label", "q", F.lit(None).cast("array<long>").alias("scores"))
    passing = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "q", "scores")
    dealt = held.unionByName(passing).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, block, current = [], None, None
        for batch in batches:
            numbers = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            ends = np.flatnonzero(np.r_[numbers[1:] != numbers[:-1], True]) + 1
            for begin, end in zip(np.r_[0, ends[:-1]], ends):
                part, number = batch.slice(begin, end - begin), int(numbers[begin]) // 2
                if number != current:
                    current, gathered, block = number, [], None
                if int(numbers[begin]) % 2 == 0:
                    gathered.append(part.select(["id", "label", "q"]))
                    continue
                if block is None and gathered:
                    block, gathered = _Block(gathered), []
                found = list(search(block, part)) if block is not None else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["anchor", "score", "id"])

    return stream_map(dealt, run, "anchor long, score long, id long")


def mined(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    id_column: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` is a condition on the column ``id``.

    ``low`` and ``high`` are per cent of the positive's score, 0 < low <= high < 100, so a window never begins above its positive.
    """
    if not 0 < low <= high < 100:
        raise ValueError("0 < low <= high < 100 is needed")
    spark = rows.sparkSession
    ship_package(spark)
    tasks = parts(spark)
    rows = integer_rows(rows, id_column, label, vector, scale)
    anchors = rows.filter(is_anchor).withColumn("scores", F.lit(None).cast("array<long>"))
    near = against_blocks(rows, anchors, lambda block, batch: _best_of_label(block, batch, positives))
    keys = near.rdd.map(lambda r: pack(r.anchor, r.score, _POSITIVE, r.id))
    found = secondary_sorted(keys, tasks).mapPartitions(lambda it: first_positives(it, positives))
    found = written(spark.createDataFrame(found, "anchor long, score long, id long"), "positives")
    windows = found.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("scores"))  # at most ``positives`` scores
    anchors = written(anchors.drop("scores").join(windows, "id"), "anchors")
    far = against_blocks(rows, anchors, lambda block, batch: _first_in_windows(block, batch, negatives, low, high))
    keys = found.rdd.map(lambda r: pack(r.anchor, r.score, _POSITIVE, r.id)).union(far.rdd.map(lambda r: pack(r.anchor, r.score, _NEGATIVE, r.id)))
    out = secondary_sorted(keys, tasks).mapPartitions(lambda it: emitted(it, negatives, low, high))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(out, schema)
