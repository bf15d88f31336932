"""Arithmetic on embeddings as Spark expressions: ``array<float>`` columns, and ML vectors whose cost goes with their stored entries."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many places other than 0, constants are looked up in a map of these; beyond, in an array of all places.
FEW_PLACES = 1_024


def is_vector(df: DataFrame, column: str) -> bool:
    """Whether a column holds ML vectors (else arrays)."""
    return isinstance(df.schema[column].dataType, VectorUDT)


def _literal(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def _long_literal(values, kind: str) -> Column:
    """A literal array of any length, as one folded expression."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def entries(vector: Column | str) -> Column:
    """``array<struct<i, v>>`` of the entries a vector stores; all of them for a dense one."""
    plain = F.unwrap_udt(vector)
    sparse = F.zip_with(plain["indices"], plain["values"], lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    dense = F.transform(plain["values"], lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v")))
    return F.when(plain["type"] == 0, sparse).otherwise(dense)


def array_entries(array: Column | str) -> Column:
    """The same for an array embedding, without its zeros."""
    column = F.col(array) if isinstance(array, str) else array
    pairs = F.transform(column, lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")))
    return F.filter(pairs, lambda e: e["v"] != 0)


def vector_size(vector: Column | str) -> Column:
    """Number of places of a vector, stored or not."""
    plain = F.unwrap_udt(vector)
    return F.coalesce(plain["size"], F.size(plain["values"]))


def constant_at(values: Sequence[float]):
    """Function from a place to the constant there."""
    array = np.asarray(values, float)
    used = np.flatnonzero(array)
    if len(used) > FEW_PLACES:
        every = _long_literal(array.tolist(), "double")
        return lambda i: F.get(every, i)
    if not len(used):
        return lambda i: F.lit(0.0)
    table = F.map_from_arrays(_long_literal(used.tolist(), "int"), _long_literal(array[used].tolist(), "double"))
    return lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0.0))


def project_score(embedding: Column | str, weights: Sequence[float] | None, vector: bool = False) -> Column:
    """Scalar product with the sentiment direction; 0 when no direction was fitted."""
    if weights is None:
        return F.lit(0.0)
    if vector:
        at = constant_at(weights)
        return F.aggregate(entries(embedding), F.lit(0.0), lambda total, e: total + e["v"] * at(e["i"]))
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    products = F.zip_with(column, _literal(weights), lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_norm(embedding: Column | str, vector: bool = False) -> Column:
    """Squared length of an embedding."""
    if vector:
        return F.aggregate(entries(embedding), F.lit(0.0), lambda total, e: total + e["v"] * e["v"])
    return F.aggregate(embedding, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y)
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)


def distance_to(embedding: str, centroid: Sequence[float], vector: bool = False) -> Column:
    """Squared distance to a constant point; for vectors from the stored entries and the point's own length."""
    if not vector:
        return squared_distance(F.col(embedding), _literal(centroid))
    at, own = constant_at(centroid), float(np.square(np.asarray(centroid, float)).sum())
    return F.aggregate(entries(embedding), F.lit(own), lambda total, e: total + e["v"] * (e["v"] - 2 * at(e["i"])))


def nearest_centroid(embedding: str, centroids: Sequence[tuple[int, Sequence[float]]], vector: bool = False) -> Column:
    """``struct<distance, cluster_id>`` of the closest centroid, lowest id first among equals.

    The centroids (k of them) are part of the expression, so rows are compared where they are, with no join.
    """
    distances = [
        F.struct(distance_to(embedding, c, vector).alias("distance"), F.lit(int(i)).alias("cluster_id")) for i, c in centroids
    ]
    return F.array_min(F.array(*distances))


#: Entries of vectors that are held against all centroids at a time.
_ENTRIES = 100_000


def all_distances(embedding: str, centroids: Sequence[Sequence[float]], vector: bool = False) -> Column:
    """``array<double>`` of the squared distances to all centroids, as ``distance_to`` has them: a matrix product per batch of rows.

    For very many rows or centroids; an expression per centroid costs an interpreted step per entry. A missing embedding has none.
    """
    points = np.asarray(centroids, float)
    own, across = np.square(points).sum(axis=1), np.ascontiguousarray(points.T)

    def measured(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.tile(own, (len(rows), 1))
        sizes = np.array([len(v) for _, v in rows])
        full = np.flatnonzero(sizes)
        if full.size:
            at, value = np.concatenate([rows[r][0] for r in full]), np.concatenate([rows[r][1] for r in full])[:, None]
            out[full] += np.add.reduceat(value * (value - 2 * across[at]), np.cumsum(sizes[full]) - sizes[full], axis=0)
        return out

    def batch(places: pd.Series, values: pd.Series) -> pd.Series:
        found, rows, waiting, held = [None] * len(values), [], [], 0
        for r, (at, value) in enumerate(zip(places, values)):
            if value is not None:
                rows.append((np.arange(len(value)) if at is None else at, np.asarray(value, float)))
                waiting.append(r)
                held += len(value)
            if rows and (held > _ENTRIES or r + 1 == len(values)):
                for place, line in zip(waiting, measured(rows)):
                    found[place] = line
                rows, waiting, held = [], [], 0
        return pd.Series(found, dtype=object)

    if vector:
        plain = F.unwrap_udt(embedding)
        places, values = plain["indices"], plain["values"]
    else:
        places, values = F.lit(None).cast("array<int>"), F.col(embedding).cast("array<double>")
    return F.pandas_udf(batch, "array<double>")(places, values)
