"""Sparse embeddings against the dense path, and the sentiment direction against numpy."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import fixtures as X
from ticketlens.functions.vectors import constant_at, distance_to, entries, nearest_centroid, project_score, squared_norm
from ticketlens.operators import direction, encoders
from ticketlens.operators import semantics as S

SF_DIR = "/root/testdata/sf0.001"


class Dense:
    """The same encoder with every place spelled out."""

    def __init__(self, inner):
        self.inner = inner

    def encode(self, df, text):
        return self.inner.encode(df, text).withColumn("embedding", vector_to_array("embedding", "float64"))


def test_levels_equal_the_dense_path(spark):
    df = X.tickets(spark, SF_DIR)
    sparse, dense = (
        S.fit_semantics(df, fit_encoder=lambda d, wrap=wrap: wrap(encoders.fit_hashed_tfidf(d))) for wrap in (lambda e: e, Dense)
    )
    assert list(sparse.levels) == ["TAB_N1", "TAB_N2", "TAB_N3"]
    for tab in sparse.levels:
        texts = df.select(F.coalesce(tab, F.lit("nan")).alias("text")).distinct()
        a, b = ({r.text: r for r in m.levels[tab].score(texts).collect()} for m in (sparse, dense))
        assert a.keys() == b.keys() and len(a) == texts.count()
        for text in a:
            assert a[text].semantic_group == b[text].semantic_group and a[text].cluster_id == b[text].cluster_id
            assert a[text].sentiment_score == pytest.approx(b[text].sentiment_score, abs=1e-9)


def test_cost_goes_with_the_terms(spark):
    """At 2^18 places a text stores as many entries as it has different terms, through all steps."""
    texts = spark.createDataFrame([("sem sinal",), ("oscilando muito hoje",), ("",), (None,)], "text string")
    encoder = encoders.fit_hashed_tfidf(texts.fillna(""), size=1 << 18)
    encoded = encoder.encode(texts, "text")
    rows = encoded.select(encoders.word_and_trigram_terms(F.coalesce("text", F.lit(""))).alias("terms"), "embedding").collect()
    assert all(r.embedding.size == 1 << 18 and len(r.embedding.indices) <= len(set(r.terms)) for r in rows)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "vector_to_array" not in plan
    levels = S.text_levels(["TAB_N3"])
    df = X.tickets(spark, SF_DIR)
    wide = S.fit_semantics(df, levels, partial(encoders.fit_hashed_tfidf, size=1 << 18))
    assert len(wide.levels["TAB_N3"].weights) == 1 << 18
    size, places, values = S.sparse_weights(wide.levels["TAB_N3"].weights)
    assert size == 1 << 18 and 0 < len(places) < 1000 and S.full_weights(size, places, values) == wide.levels["TAB_N3"].weights
    enriched = wide.transform(df)
    assert enriched.filter("TAB_N3_GROUP IS NULL OR TAB_N3_SENT_SCORE IS NULL").count() == 0


def random_vectors(rnd, n, size, most):
    out = []
    for _ in range(n):
        places = sorted(rnd.sample(range(size), rnd.randint(0, most)))
        out.append(Vectors.sparse(size, places, [rnd.gauss(0, 1) for _ in places]))
    return out


def test_vector_expressions(spark):
    rnd = random.Random(1)
    vectors = random_vectors(rnd, 30, 3000, 40) + [Vectors.dense([rnd.gauss(0, 1) for _ in range(3000)])]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("embedding", VectorUDT())])
    df = spark.createDataFrame(list(enumerate([*vectors, None])), schema)
    few, many = np.zeros(3000), np.array([rnd.gauss(0, 1) for _ in range(3000)])
    few[[3, 77, 2999]] = [1.0, -2.0, 0.5]
    for weights in (few, many, np.zeros(3000)):
        rows = df.select(
            "id",
            project_score("embedding", weights.tolist(), True).alias("dot"),
            distance_to("embedding", weights, True).alias("far"),
            squared_norm("embedding", True).alias("norm"),
            nearest_centroid("embedding", [(0, weights), (1, few), (2, few)], True)["cluster_id"].alias("best"),
        ).collect()
        for r in rows[:-1]:
            v = vectors[r.id].toArray()
            assert r.dot == pytest.approx(v @ weights) and r.norm == pytest.approx(v @ v) and r.far == pytest.approx(((v - weights) ** 2).sum())
            assert r.best == int(np.argmin([((v - c) ** 2).sum() for c in (weights, few)]) if not np.array_equal(weights, few) else 0)
        assert rows[-1].dot is None and rows[-1].norm is None
    assert df.select(F.size(entries("embedding")).alias("n")).collect()[30].n == 3000
    assert spark.range(1).select(constant_at(many)(F.lit(7)).alias("x")).first().x == many[7]


def seeds_of(spark, vectors, scores):
    schema = T.StructType([T.StructField("embedding", VectorUDT()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(list(zip(vectors, scores)), schema)


@pytest.mark.parametrize("few", [True, False])
def test_direction_is_the_minimum_norm(spark, few):
    """Both ways at 2^18 places: repeated, contradicting and empty seeds among them."""
    rnd, size = random.Random(3), 1 << 18
    pool = rnd.sample(range(size), 120)
    vectors = []
    for _ in range(30):
        places = sorted(rnd.sample(pool, 12))
        vectors.append(Vectors.sparse(size, places, [rnd.gauss(0, 1) for _ in places]))
    vectors += [vectors[0], vectors[1], Vectors.sparse(size, [], [])]
    scores = [rnd.uniform(-1, 1) for _ in vectors]
    got = np.array(S.seed_direction(seeds_of(spark, vectors, scores), **({} if few else {"few_seeds": 0})))
    used = sorted(pool)
    matrix = np.array([v.toArray()[used] for v in vectors])
    want = np.linalg.pinv(matrix) @ np.array(scores)
    assert len(got) == size and np.abs(got[used] - want).max() < 1e-6 and np.count_nonzero(got) <= len(used)


def test_direction_of_arrays_by_steps(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(40, 12))
    scores = rng.normal(size=40)
    seeds = spark.createDataFrame([(r.tolist(), float(s)) for r, s in zip(matrix, scores)] + [(None, 1.0)], "embedding array<double>, score double")
    want = np.linalg.lstsq(matrix, scores, rcond=None)[0]
    for options in ({}, {"few_seeds": 0}, {"few_entries": 1}):
        assert np.allclose(direction.seed_direction(seeds, **options), want, atol=1e-6)
    assert direction.seed_direction(seeds.filter("embedding IS NULL")) is None
    nothing = spark.createDataFrame([([0.0, 0.0], 1.0)], "embedding array<double>, score double")
    assert direction.seed_direction(nothing) == [0.0, 0.0] == direction.seed_direction(nothing, few_seeds=0)


def test_no_text_with_an_embedding(spark):
    table = spark.createDataFrame([("other", [1.0, 0.0])], "text string, embedding array<float>")
    with pytest.raises(ValueError, match="TAB_N1"):
        S.fit_semantics(X.tickets(spark, SF_DIR), S.text_levels(["TAB_N1"]), lambda d: encoders.TableEncoder(table))
