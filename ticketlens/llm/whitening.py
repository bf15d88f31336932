"""Embedding whitening by weighted multiplicity covariance.

Identical vectors are grouped first; a vector's weight in the fit is its count, or one. Sums of the integer vectors are exact. Each task
multiplies its centred vectors, weighted, as one matrix product; the entries are added up by Spark, so the driver holds a matrix of the
vectors' length squared, whatever the number of rows. Its eigenvectors whiten each distinct vector once, and the rows get their vector's
result by a join that spreads vectors of many rows over several tasks.

A vector enters as integers x = floor(scale * c) + offset. Centred means x - S/n with the exact sums S: the integer part of S/n is taken
off as an integer, only the rest (below one) in doubles, so a large offset costs no digits.

Defined results: a vector that is null, empty, or holds a null or non-finite entry takes no part, nor one with an entry x beyond 2^40;
of vectors of different lengths the commonest length counts (the longer at a tie). Directions without variance (eigenvalue within
rounding of 0) are not components, so equal vectors, or a single one, give no rows. Rows that repeat an id are rows of their own; a null id
stays null; labels and other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stream_map
from ticketlens.operators.joins import lookup_join
from ticketlens.runtime import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = 1 << 40
#: Whitened tables beyond this size are not broadcast to the rows.
BROADCAST_BYTES = 8 << 20
_DECIMAL = pa.decimal128(38, 0)


def finite_vector(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x) of the rows that take part."""
    doubles = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("double") + float(offset))
    rows = rows.filter(finite_vector(F.col(vector))).select(F.col(id_column).alias(id_column), doubles.alias("_x"))
    rows = rows.filter(F.forall("_x", lambda c: F.abs(c) <= float(LARGEST)))  # as doubles, so that no cast can overflow
    return rows.select(id_column, F.transform("_x", lambda c: c.cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, vector: str, weight: str) -> dict[int, Decimal | float]:
    """Weighted sum per place, added up in Spark: exact for integers."""
    exact = "bigint" in rows.schema[vector].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch, vector), batch.column(weight).to_numpy()
            if exact and int(np.abs(x).max()) * int(w.sum()) >= 2**62:
                part = (x.astype(object) * w.astype(object)[:, None]).sum(0)
            else:
                part = w @ x if not exact else (x * w[:, None]).sum(0).astype(object)
            total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], _DECIMAL) if exact else pa.array(np.asarray(total, float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], ["i", "v"])

    parts = stream_map(rows.select(vector, weight), run, f"i int, v {'decimal(38,0)' if exact else 'double'}")
    return {r.i: r.v for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}  # a row per place


def _products(rows: DataFrame, vector: str, weight: str, centred) -> np.ndarray:
    """Sum of the weighted products of centred vectors with themselves: one matrix product per batch, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                c, w = centred(_matrix(batch, vector)), batch.column(weight).to_numpy().astype(float)
                part = (c * w[:, None]).T @ c
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    parts = stream_map(rows.select(vector, weight), run, "i int, j int, v double")
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # a row per pair of places
    size = int(cells["i"].max()) + 1 if len(cells) else 0
    out = np.zeros((size, size))
    i, j = cells["i"].to_numpy(int), cells["j"].to_numpy(int)
    out[i, j] = out[j, i] = cells["v"].to_numpy(float)
    return out


@dataclass(frozen=True)
class Whitening:
    """Fitted from ``n`` vectors: whole and remaining part of the mean (``rest`` / n), components as columns, their eigenvalues."""

    n: int
    pivot: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot) - self.rest.astype(float) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the places of (n x - S)^2, exact."""
        gaps = x - self.pivot
        if (self.n * (int(np.abs(gaps).max(initial=0)) + 1)) ** 2 * x.shape[1] < 2**62:
            return [int(v) for v in ((self.n * gaps - self.rest.astype(np.int64)) ** 2).sum(1)]
        return [int(v) for v in ((self.n * gaps.astype(object) - self.rest) ** 2).sum(1)]


def distinct_vectors(vectors: DataFrame, weights: str = "counts") -> DataFrame:
    """(x, copies, weight) of the vectors of the commonest length; ``weights``: counts or one."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    found = written(vectors.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    length = found.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    return found.filter(F.size("x") == (length.d if length else 0)).withColumn("weight", weight)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """None without vectors."""
    n = distinct.agg(F.sum("weight")).first()[0]
    if not n:
        return None
    sums = _sums(distinct, "x", "weight")
    split = [divmod(int(sums[i]), n) for i in range(len(sums))]
    pivot, rest = np.array([p for p, _ in split], np.int64), np.array([r for _, r in split], object)
    mean_rest = rest.astype(float) / n
    covariance = _products(distinct, "x", "weight", lambda x: (x - pivot) - mean_rest) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = values > len(values) * np.finfo(float).eps * max(float(values[0]), 0.0)
    count = min(components, int(used.sum()))
    values, vectors = values[:count], vectors[:, :count]
    largest = np.abs(vectors).argmax(0) if count else np.zeros(0, int)
    vectors = vectors * np.where(vectors[largest, np.arange(count)] < 0, -1.0, 1.0)  # the same sign in every run
    return Whitening(n, pivot, rest, vectors, values, float(np.trace(covariance)))


def whitened_vectors(distinct: DataFrame, model: Whitening) -> DataFrame:
    """(x, copies, weight, deviation, whitened) of each distinct vector; ``deviation`` as decimal(38, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            white = np.ascontiguousarray(model.whiten(x))
            offsets = pa.array(np.arange(0, white.size + 1, max(1, white.shape[1]), dtype=np.int32)[: len(x) + 1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
            deviations = pa.array([Decimal(v) for v in model.deviations(x)], _DECIMAL)
            yield pa.RecordBatch.from_arrays([*batch.columns, deviations, lists], [*batch.schema.names, "deviation", "whitened"])

    return stream_map(distinct, run, "x array<long>, copies long, weight long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, n: int) -> float:
    """Largest absolute entry of the weighted covariance of the whitened vectors minus the identity."""
    sums = _sums(white, "whitened", "weight")
    mean = np.array([sums[i] for i in range(len(sums))]) / n
    covariance = _products(white, "whitened", "weight", lambda v: v - mean) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))


def whitened(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    weights: str = "counts",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> tuple[DataFrame, Whitening | None, float | None]:
    """(id, deviation, whitened array) per row that takes part; the fitted model; its identity error. Without components no row."""
    vectors = written(integer_vectors(rows, id_column, vector, scale, offset), "integers")
    distinct = distinct_vectors(vectors, weights)
    model = fit(distinct, components)
    if model is None or not len(model.values):
        empty = vectors.limit(0).select(id_column, F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
        return empty, model, None
    white = written(whitened_vectors(distinct, model), "whitened")
    error = identity_error(white, model.n)
    hashed = F.xxhash64("x").alias("_h")  # sorted by first; the vector itself decides
    lookup = white.select(hashed, "x", "copies", "deviation", "whitened")
    facts = vectors.filter(F.size("x") == len(model.pivot)).select(id_column, hashed, "x", F.monotonically_increasing_id().alias("_row"))
    joined = lookup_join(facts, lookup, ["_h", "x"], "copies", ["_row"], broadcast_bytes=BROADCAST_BYTES)
    return joined.select(id_column, "deviation", "whitened"), model, error


def components(rows: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A deviation beyond 64 bits reads null here; ``whitened`` returns it as a decimal.
    """
    out, model, error = whitened(rows, components=count)
    explained = model.explained if model is not None and len(model.values) else [0.0]
    long_range = F.col("deviation") <= F.lit(Decimal(2**63 - 1)).cast("decimal(38,0)")
    out = out.select("vec_id", F.when(long_range, F.col("deviation")).cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n if model is not None else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.lit(explained), F.col("_at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
