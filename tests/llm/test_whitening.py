import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import whitening
from ticketlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(vector):
    return vector is not None and len(vector) > 0 and all(c is not None and math.isfinite(c) for c in vector)


def brute(rows, count=32, weights="counts"):
    """Per row (id, integer vector), and n, exact sums, eigenvalues and components by plain exact sums."""
    rows = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    lengths = [len(x) for _, x in rows]
    length = max(set(lengths), key=lambda d: (lengths.count(d), d))
    rows = [(i, x) for i, x in rows if len(x) == length]
    fit = [x for _, x in rows] if weights == "counts" else [list(x) for x in {tuple(x) for _, x in rows}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    scaled = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], object)
    covariance = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in scaled.T @ scaled])
    values, vectors = np.linalg.eigh(covariance)
    return rows, n, sums, values[::-1][:count], vectors[:, ::-1][:, :count], float(np.trace(covariance))


def check(frame, rows):
    got = whitening.components(frame).collect()
    rows, n, sums, values, vectors, trace = brute(rows)
    used = int((values > 1e-9 * values[0]).sum())
    assert len(got) == len(rows) * used
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x in rows:
        gaps = [n * c - s for c, s in zip(x, sums)]
        centred = np.array([g / n for g in gaps])
        for k in range(used):
            r = by_id[i][k + 1][0]
            assert r.n == n and r.deviation == sum(g * g for g in gaps)
            want = float(centred @ vectors[:, k]) / math.sqrt(values[k])
            if abs(want) > 1e-3:
                signs.setdefault(k, set()).add(want * r.whitened > 0)
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-9) and r.identity_error < 1e-8
    assert all(len(s) == 1 for s in signs.values())
    return got


def test_real(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(frame, [(r.vec_id, r.embedding) for r in frame.collect()])


def random_rows(n, d, seed=1):
    rnd = np.random.default_rng(seed)
    scales = np.linspace(3.0, 0.5, d)
    return [(i, [float(np.float32(v)) for v in rnd.normal(size=d) * scales], 0) for i in range(n)]


def test_copies_and_odd_vectors(spark):
    rows = random_rows(60, 6)
    rows += [(100 + i, rows[0][1], 1) for i in range(40)]  # a vector of a third of all rows
    rows += [(7, rows[3][1], 1), (None, rows[4][1], None)]  # a repeated id, a null id
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [3e38] * 6]
    frame = spark.createDataFrame(rows + [(1000 + i, v, 0) for i, v in enumerate(odd)], SCHEMA).withColumn("n", F.lit("x")).repartition(3)
    plain = [(i, v) for i, v, _ in rows if i not in (7, None)]
    out, model, error = whitening.whitened(frame)
    assert model.n == len(rows) and error < 1e-8 and out.count() == len(rows)
    check(frame.filter("vec_id <> 7"), plain)


def test_weight_one(spark):
    rows = random_rows(50, 5)
    frame = spark.createDataFrame(rows + [(200 + i, rows[0][1], 0) for i in range(30)], SCHEMA)
    out, model, error = whitening.whitened(frame, weights="one")
    _, n, _, values, _, _ = brute([(i, v) for i, v, _ in rows], weights="one")
    assert model.n == n == 50 and np.allclose(model.values, values, rtol=1e-9) and error < 1e-8 and out.count() == 80
    with pytest.raises(ValueError):
        whitening.distinct_vectors(whitening.integer_vectors(frame), "half")


def test_no_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)
    for frame in (empty, one):
        out = whitening.components(frame)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)], SCHEMA)  # one direction
    assert {r.component for r in whitening.components(flat).collect()} == {1}


def test_deviation_beyond_64_bits(spark):
    big = float(2**30)
    frame = spark.createDataFrame([(i, [big * (i % 5), -big * (i % 3)], 0) for i in range(64)], SCHEMA)
    rows, n, sums, *_ = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    out = whitening.whitened(frame)[0].collect()
    want = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in rows}
    assert max(want.values()) > 2**63 and all(r.deviation == Decimal(want[r.vec_id]) for r in out)
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in whitening.components(frame).collect())


def test_exact_sums(spark):
    rows = spark.createDataFrame([([2**40, -(2**40), 3], 2**23 + 1), ([2**40 - 1, 7, 0], 2**22)], "x array<long>, weight long")
    got = whitening._sums(rows, "x", "weight")
    assert [int(got[i]) for i in range(3)] == [2**40 * (2**23 + 1) + (2**40 - 1) * 2**22, -(2**40) * (2**23 + 1) + 7 * 2**22, 3 * (2**23 + 1)]


def test_query(spark, sf_dir):
    out = QUERIES["op12_embedding_whitening"](spark, sf_dir)
    assert out.count() == 32 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    white = np.array([r.w for r in out.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("component", "whitened"))).whitened.alias("w")).collect()])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(32)).max() == pytest.approx(out.first().identity_error, abs=1e-9)
