import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import classifier
from ticketlens.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op7_ftrl_quality"](spark, sf).join(labels, "doc_id").filter("held_out")
    rows = {(r.quality, r.predicted): r["count"] for r in out.groupBy("quality", "predicted").count().collect()}
    assert rows[0, 0] / (rows[0, 0] + rows.get((0, 1), 0)) > 0.95
    assert rows[1, 1] / (rows[1, 1] + rows.get((1, 0), 0)) > 0.99


def test_updates_match_the_plain_algorithm():
    """Against one coordinate at a time, in plain Python."""
    rng = np.random.default_rng(0)
    model, z, n = classifier.Ftrl(20), [0.0] * 21, [0.0] * 21
    a, b, l1, l2 = classifier.ALPHA, classifier.BETA, classifier.L1, classifier.L2
    for _ in range(200):
        at = np.sort(rng.choice(20, 5, replace=False))
        x, y = rng.random(5), int(rng.random() < 0.5)
        at, x = np.append(at, 20), np.append(x, 1.0)
        w = [0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2) for i in at]
        p = 1 / (1 + np.exp(-sum(wi * xi for wi, xi in zip(w, x))))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * wi
            n[i] += g * g
        model.learn(at.astype(np.int64), x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_score_is_the_dot_product():
    w = np.random.default_rng(1).normal(size=(1 << classifier.BITS) + 1)
    text = "One two two THREE!! 4-5 é"
    h = classifier.features(text)
    at, x = classifier._vector(h)
    assert np.isclose(w[at] @ x, w[-1] + w[h].sum() / np.sqrt(len(h)))
    assert classifier.shapes(b"ABC-12 aa!! 9") == [b"A-0", b"a!", b"0"]
    assert len(classifier.features("")) == 0 and len(classifier.features(" \n")) == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (14, 0, 0), (12, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    weights = classifier.fit(odd_docs, labels)
    out = classifier.scored(odd_docs, weights)
    assert out.columns.count("score") == 1 and out.count() == odd_docs.count() and classifier.scored(no_docs, weights).count() == 0
    rows = {r.doc_id: r.score for r in out.collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and rows[4] == rows[5] == rows[6] and rows[0] == rows[1]
    assert rows[0] > rows[14]


def test_one_class_or_none(spark, odd_docs):
    none = classifier.fit(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in classifier.scored(odd_docs, none).collect()} == {0.5}
    good = classifier.fit(odd_docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert classifier.scored(odd_docs, good).filter(F.col("score") < 0.9).count() == 0


def test_training_repeats(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert np.array_equal(classifier.fit(docs, labels), classifier.fit(docs.repartition(5), labels))
