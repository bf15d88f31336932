"""The sentiment direction: minimum-norm least squares of seed scores on seed embeddings, of any length and in any number."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.vectors import array_entries, entries, is_vector, vector_size
from ticketlens.runtime import ship_package, written

log = logging.getLogger(__name__)

#: Up to so many seeds with so many entries, they are solved on the driver by their m x m products.
FEW_SEEDS, FEW_ENTRIES = 2_000, 4_000_000
_COLUMNS = 4_096


def _solved(indices: np.ndarray, values: np.ndarray, lengths: np.ndarray, scores: np.ndarray, size: int) -> np.ndarray:
    """A^T (A A^T)^+ s; the product is added up over blocks of columns, so no matrix of the embedding's length is made."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    used, place = np.unique(indices, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner_, place_, values_ = owner[order], place[order], values[order]
    gram = np.zeros((len(lengths), len(lengths)))
    for at in range(0, len(used), _COLUMNS):
        begin, end = np.searchsorted(place_, (at, at + _COLUMNS))
        block = np.zeros((len(lengths), min(_COLUMNS, len(used) - at)))
        np.add.at(block, (owner_[begin:end], place_[begin:end] - at), values_[begin:end])
        gram += block @ block.T
    dual = np.linalg.pinv(gram, rcond=1e-11, hermitian=True) @ scores
    return np.bincount(indices, weights=values * dual[owner], minlength=size)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and number of entries of each row."""
    lengths = batch.column("i").value_lengths().to_numpy(zero_copy_only=False)
    return batch.column("i").flatten().to_numpy(), batch.column("v").flatten().to_numpy(), lengths


def _normal_product(rows: DataFrame, p: np.ndarray | None, size: int) -> np.ndarray:
    """A^T A p, or A^T s without ``p``: one aggregate over the seeds, a row per place to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            i, v, lengths = _flat(batch)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            q = batch.column("score").to_numpy() if p is None else np.bincount(owner, weights=v * p[i], minlength=len(lengths))
            total += np.bincount(i, weights=v * q[owner], minlength=size)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["i", "v"])

    found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[found["i"].to_numpy(int)] = found["v"].to_numpy(float)
    return out


def _conjugate_gradients(rows: DataFrame, size: int, steps: int, tolerance: float) -> np.ndarray:
    """Conjugate gradients on the normal equations from 0, which stay in the span of the seeds and so end at the minimum norm."""
    solution, rest = np.zeros(size), _normal_product(rows, None, size)
    towards, first = rest.copy(), float(rest @ rest)
    now = first
    for _ in range(steps):
        if now <= tolerance**2 * first:
            return solution
        product = _normal_product(rows, towards, size)
        step = now / float(towards @ product)
        solution += step * towards
        rest -= step * product
        before, now = now, float(rest @ rest)
        towards = rest + now / before * towards
    log.warning("the sentiment direction is left at a relative residual of %.1e after %d steps", (now / first) ** 0.5, steps)
    return solution


def seed_direction(
    seeds: DataFrame,
    embedding: str = "embedding",
    score: str = "score",
    few_seeds: int = FEW_SEEDS,
    few_entries: int = FEW_ENTRIES,
    steps: int = 2_000,
    tolerance: float = 1e-13,
) -> list[float] | None:
    """Minimum-norm least-squares solution of ``embedding . w = score`` over the seeds; None without seeds.

    Few seeds (counted first) are solved on the driver by their own products. Otherwise each step of conjugate gradients is one aggregate
    over the seeds; the driver holds a few vectors of the embedding's length. Seeds without an embedding are left out.
    """
    known = seeds.filter(F.col(embedding).isNotNull() & F.col(score).isNotNull())
    vector = is_vector(seeds, embedding)
    stored = entries(embedding) if vector else array_entries(embedding)
    size = vector_size(embedding) if vector else F.size(embedding)
    rows = known.select(F.col(score).cast("double").alias("score"), size.alias("size"), stored.alias("e"))
    rows = rows.select("score", "size", F.col("e.i").alias("i"), F.col("e.v").alias("v"))
    rows = written(rows, "seeds")
    count, length, found = rows.agg(F.count("*"), F.max("size"), F.sum(F.size("i"))).first()
    if not count:
        return None
    if count <= few_seeds and found <= few_entries:
        table = rows.select("score", "i", "v").toArrow().combine_chunks()
        parts = [_flat(batch) for batch in table.to_batches()]
        i, v, lengths = (np.concatenate(x) for x in zip(*parts))
        return _solved(i, v, lengths, table["score"].to_numpy(), length).tolist()
    ship_package(seeds.sparkSession)
    return _conjugate_gradients(rows, length, steps, tolerance).tolist()
