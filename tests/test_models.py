"""Learned operators: invariants, persistence, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params, schemas
from ticketlens.operators import encoders, training
from ticketlens.operators import semantics as S
from ticketlens.operators.prepare import prepare
from ticketlens.plans.end_to_end import run, run_from_splits
from ticketlens.sources.tables import read_table
from ticketlens.streaming import scoring

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    output = str(tmp_path_factory.mktemp("run"))
    return output, run(X.tickets(spark, SF_DIR), output=output, trees=5)


def test_run_shapes(whole):
    _, result = whole
    assert len(result.training.inputs) == 43
    assert {r.dataset for r in result.training.metrics.collect()} == set(params.SPLITS)
    assert result.training.threshold in [*params.DECISION_THRESHOLDS, params.FALLBACK_THRESHOLD]
    assert sum(r.importance for r in result.training.importances.collect()) == pytest.approx(1)
    assert {"headline", "metrics", "overfitting", "importances", "clusters", "comparison", "occurrences", "confusion"} <= set(result.reports)


def test_run_outputs(spark, whole):
    output, result = whole
    loaded = training.load_model(f"{output}/model")
    matrix = training.feature_matrix(result.features)
    a = training.predict(result.training.model, matrix).agg(F.sum("p")).first()[0]
    b = training.predict(loaded, matrix).agg(F.sum("p")).first()[0]
    assert a == pytest.approx(b, abs=1e-9)
    assert read_table(spark, f"{output}/metrics").count() == 3
    dictionary = read_table(spark, f"{output}/cluster_dictionary")
    assert dictionary.filter("tab = 'TAB_N1'").count() <= 4  # no more clusters than distinct texts


def test_one_class_validation_gives_fallback(spark):
    df = prepare(X.tickets(spark, SF_DIR)).withColumn("TARGET", F.when(F.col("split") == "train", F.col("TARGET")).otherwise(0))
    result = run_from_splits(df, trees=2)
    assert result.training.threshold == params.FALLBACK_THRESHOLD
    assert {r.dataset: r.auc_roc for r in result.training.metrics.collect()}["validation"] is None


def test_fit_is_repeatable(spark):
    df = prepare(X.tickets(spark, SF_DIR))
    one, two = (S.fit_semantics(df.repartition(n), S.text_levels(["TAB_N3"])) for n in (2, 5))
    assert one.levels["TAB_N3"].labels == two.levels["TAB_N3"].labels


def test_unknown_column_and_unfitted_model_are_errors(spark):
    with pytest.raises(ValueError):
        S.text_levels(["TAB_N9"])
    with pytest.raises(ValueError):
        S.SemanticModel({}).transform(spark.range(1))
    with pytest.raises(ValueError):
        S.fit_semantics(X.tickets(spark, SF_DIR).limit(0), S.text_levels(["TAB_N1"]))


def test_absent_columns_are_skipped(spark):
    df = X.tickets(spark, SF_DIR).drop("TAB_N2", "TAB_N3")
    model, enriched = S.enrich(df)
    assert list(model.levels) == ["TAB_N1"] and "TAB_N1_GROUP" in enriched.columns and "TAB_N2_GROUP" not in enriched.columns


def test_cluster_count():
    assert [S.cluster_count(12, n, t) for n, t in ((1, 1), (5, 3), (100, 40), (100, 7))] == [2, 3, 12, 7]


def test_full_rank_seeds_are_reproduced(spark):
    rng = np.random.default_rng(1)
    vectors, scores = rng.normal(size=(6, 16)), rng.normal(size=6)
    seeds = spark.createDataFrame([(v.tolist(), float(s)) for v, s in zip(vectors, scores)], "embedding array<double>, score double")
    w = np.array(S.seed_direction(seeds))
    assert np.allclose(vectors @ w, scores, atol=1e-6)
    # minimum norm: the direction lies in the span of the seeds
    assert np.allclose(vectors.T @ np.linalg.lstsq(vectors.T, w, rcond=None)[0], w)
    assert S.seed_direction(seeds.limit(0)) is None


def test_no_seeds_score_zero(spark):
    model = S.fit_semantics(X.tickets(spark, SF_DIR), [S.TextLevel("TAB_N1", 3)])
    row = model.transform(X.tickets(spark, SF_DIR)).select("TAB_N1_SENT_SCORE", "TAB_N1_SENT_LABEL").distinct().collect()
    assert [(r[0], r[1]) for r in row] == [(0.0, "neutro")]


def test_null_text_option(spark):
    df = X.tickets(spark, SF_DIR)
    texts = {r.text for r in S.text_dictionary(df, ["TAB_N2"], null_text="").collect()}
    assert "" in texts and "nan" not in texts


def test_save_and_load_with_given_centroids(spark, tmp_path):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "text string, embedding array<float>")
    level = S.LevelModel("TAB_N1", encoders.TableEncoder(table), S.GivenCentroids(((1.0, 0.0), (0.0, 1.0))), ((0, "first"),), (0.9, -0.9))
    model = S.SemanticModel({"TAB_N1": level})
    S.save_semantics(model, spark, str(tmp_path / "m"))
    loaded = S.load_semantics(spark, str(tmp_path / "m"), ["TAB_N1"])
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "TAB_N1 string")
    for m in (model, loaded):
        got = {r.TAB_N1: (r.TAB_N1_GROUP, r.TAB_N1_SENT_LABEL) for r in m.transform(df).collect()}
        assert got == {"a": ("first", "positivo"), "b": ("cluster_1", "insatisfacao"), "c": (None, "neutro")}


def test_stream_scores_like_batch(spark, whole, tmp_path):
    _, result = whole
    folder = str(tmp_path / "in")
    tickets = X.tickets(spark, SF_DIR)
    tickets.repartition(3).write.parquet(folder)

    def score(df):
        labelled = df.withColumn("TARGET", F.lit(0)).drop("ID_CLIENTE", "CODIGO", "NUMERO_OS")
        return scoring.score_tickets(labelled, result.semantics, result.training.model, "TARGET", ["PROTOCOLO"])

    stream = scoring.ticket_stream(spark, folder, schemas.RAW_TICKETS, files_per_trigger=1)
    scoring.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), score)
    streamed = {r.PROTOCOLO: r.p for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.PROTOCOLO: r.p for r in score(tickets).collect()}
    assert len(batch) == tickets.count() and streamed == pytest.approx(batch)
