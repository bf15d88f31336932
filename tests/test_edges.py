"""Inputs that once were refused, cut or lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.catalog.models import letter_counts
from ticketlens.operators import encoders, training
from ticketlens.operators import metrics as M
from ticketlens.operators import semantics as S
from ticketlens.operators.clusters import top_terms
from ticketlens.operators.joins import lookup_join
from ticketlens.operators.split import customer_split, stratified_split
from ticketlens.plans.end_to_end import report_tables, run_from_splits
from ticketlens.plans.report import semantic_clusters
from ticketlens.sources import tables as T


def test_many_split_names_and_a_holdout(spark):
    df = spark.range(3000).withColumn("split", F.concat(F.lit("fold"), F.col("id") % 150))
    df = df.unionByName(spark.createDataFrame([(1, "train"), (2, "holdout")], "id long, split string"))
    found = {r.split: r.rows for r in T.splits_present(df).collect()}
    assert len(found) == 152 and found["holdout"] == 1 and T.check_splits(df) == ["train"]


def test_one_distinct_text(spark):
    df = spark.createDataFrame([("same",)] * 5 + [("same",)], "TAB_N1 string")
    _, out = S.enrich(df, S.text_levels(["TAB_N1"]))
    assert {r.TAB_N1_GROUP for r in out.collect()} == {"same"}
    blank = spark.createDataFrame([("",), ("??",)], "TAB_N1 string")
    assert S.enrich(blank, S.text_levels(["TAB_N1"]))[1].count() == 2


def test_no_text_column(spark):
    df = spark.createDataFrame([(1, "train")], "x int, split string")
    model, out = S.enrich(df)
    assert model.levels == {} and out.columns == df.columns and out.count() == 1


def test_any_number_of_seeds(spark):
    rng = np.random.default_rng(0)
    e, s = rng.normal(size=(2500, 6)), rng.normal(size=2500)
    seeds = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(e, s)], "embedding array<double>, score double")
    assert np.allclose(S.seed_direction(seeds), np.linalg.lstsq(e, s, rcond=None)[0])
    few = seeds.limit(3)
    rows = few.collect()
    want = np.linalg.lstsq(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), rcond=None)[0]
    assert np.allclose(S.seed_direction(few), want, atol=1e-6)
    assert S.seed_direction(seeds.filter("score > 1e9")) is None


def test_null_keys_keep_the_shares(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), "id", (F.col("id") % 2).cast("int").alias("TARGET"))
    counts = {r.split: r["count"] for r in stratified_split(df, "TARGET", "k").groupBy("split").count().collect()}
    assert counts == {"train": 1600, "validation": 200, "test": 200}


def test_rows_without_a_customer_get_a_split(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 90).alias("c"), "id", (F.col("id") % 2).cast("int").alias("TARGET"))
    out = customer_split(df, "c", "TARGET")
    assert out.count() == 1000 and out.filter("split IS NULL").count() == 0
    none = {r.split: r["count"] for r in out.filter("c IS NULL").groupBy("split").count().collect()}
    assert none == {"train": 80, "validation": 10, "test": 10}


def test_lookup_with_a_null_weight_keeps_its_rows(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    lookup = spark.createDataFrame([("a", "A", 1), ("b", "B", None)], "k string, v string, n long")
    out = lookup_join(facts, lookup, ["k"], "n", ["x"], broadcast_rows=0)
    assert {(r.k, r.v) for r in out.collect()} == {("a", "A"), ("b", "B")}


def test_small_scores_keep_their_terms(spark):
    scores = spark.createDataFrame([(0, "a", 3e-12), (0, "b", 2e-12), (0, "c", 0.0)], "g int, term string, score double")
    assert [r.term for r in top_terms(scores, ["g"]).orderBy("rank").collect()] == ["a", "b"]


def test_datasets_of_either_run_are_compared(spark):
    now = spark.createDataFrame([("train", 1.0, 1.0, 1.0, 1.0), ("holdout", 0.5, 0.5, 0.5, 0.5)], "dataset string, auc_roc double, precision double, recall double, f1_score double")
    got = {r.dataset: r.stored_f1_score for r in M.compare_runs(now, M.stored_metrics(spark)).collect()}
    assert set(got) == {"train", "validation", "test", "holdout"} and got["holdout"] is None


def test_empty_metrics_give_no_verdict(spark):
    empty = spark.createDataFrame([], "dataset string, auc_roc double, precision double, recall double, f1_score double")
    assert M.overfitting_check(empty).count() == M.acceptance_gate(empty).count() == 0


def test_stored_levels_are_found(spark, tmp_path):
    df = spark.createDataFrame([("aa", "b"), ("bb", "c"), ("ca", "a")], "KIND string, OTHER string")
    levels = S.text_levels(["KIND"], {"KIND": 2}, [("KIND", "aa", 1.0)])
    own = encoders.BatchEncoder(letter_counts)
    model, _ = S.enrich(df, levels, lambda dictionary: own)
    S.save_semantics(model, spark, str(tmp_path / "m"))
    loaded = S.load_semantics(spark, str(tmp_path / "m"), encoder=own)
    assert list(loaded.levels) == ["KIND"]
    assert list(S.load_semantics(spark, str(tmp_path / "m"), ["KIND", "TAB_N1"], own).levels) == ["KIND"]
    with pytest.raises(ValueError):
        S.load_semantics(spark, str(tmp_path / "m"))


def test_run_with_own_levels_and_blocks(spark, tmp_path):
    rows = [(i, ("aa", "bb", "ab ba")[i % 3], i % 2, ("train", "validation", "test")[i % 3 if i % 5 else 0]) for i in range(120)]
    df = spark.createDataFrame(rows, "PROTOCOLO long, KIND string, TARGET int, split string")
    levels = S.text_levels(["KIND"], {"KIND": 2}, [("KIND", "aa", 1.0)])
    own_block = lambda columns: {"flag_never": F.lit(0), "flag_odd": (F.col("PROTOCOLO") % 2).cast("int")}
    done = run_from_splits(df, levels, with_report=True, output=str(tmp_path / "out"), blocks=(own_block,), trees=2)
    occur = {r[0]: r for r in done.reports["occurrences"].collect()}
    assert {"flag_never", "flag_odd"} <= set(occur)
    assert {r.tab for r in done.reports["clusters"].collect()} == {"KIND"}
    assert spark.read.json(str(tmp_path / "out/cluster_json")).count() == 2
    assert {r.dataset for r in done.training.metrics.collect()} == set(params.SPLITS)
    assert "overfitting_check" in report_tables(done.training, done.enriched) and semantic_clusters(done.enriched).count() == 2


def test_hot_text_in_a_table_encoder(spark):
    table = encoders.TableEncoder(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "text string, embedding array<float>"))
    df = spark.createDataFrame([("a",)] * 50 + [("b",), ("x",), (None,)], "t string")
    out = {(r.t, tuple(r.embedding) if r.embedding else None): r["count"] for r in table.encode(df, "t").groupBy("t", "embedding").count().collect()}
    assert out == {("a", (1.0,)): 50, ("b", (2.0,)): 1, ("x", None): 1, (None, None): 1}


def test_unlike_texts_rarely_share_a_vector(spark):
    words = [f"{a}{b}{c}" for a in "bcdfglm" for b in "aeiou" for c in "nrstvxz"]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    vectors = encoders.fit_hashed_tfidf(df).encode(df, "text").select("embedding").distinct().count()
    assert vectors >= len(words) - 2


def test_training_keeps_the_stored_partitions():
    import inspect

    assert "coalesce(" not in inspect.getsource(training.fit_model)
