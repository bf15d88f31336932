"""Splits, joins, metrics and cluster labels against brute force on small tables."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.operators import clusters, profile, split
from ticketlens.operators import metrics as M
from ticketlens.operators.joins import lookup_join
from ticketlens.sources import tables as T


@pytest.mark.parametrize("rows", [1, 9, 10, 11, 237])
def test_split_sizes_per_class(spark, rows):
    df = spark.range(rows * 3).select(F.col("id").alias("PROTOCOLO"), (F.col("id") % 3 == 0).cast("int").alias("TARGET"))
    placed = split.stratified_split(df)
    sizes = Counter((r.TARGET, r.split) for r in placed.collect())
    for target, n in ((1, rows), (0, rows * 2)):
        train, upto = n * 8 // 10, n * 9 // 10
        assert [sizes[target, s] for s in params.SPLITS] == [train, upto - train, n - upto]
    assert placed.count() == rows * 3


def test_split_is_stable_and_seeded(spark):
    df = spark.range(500).select(F.col("id").alias("PROTOCOLO"), F.lit(0).alias("TARGET"))
    def of(seed, parts):
        return {r.PROTOCOLO: r.split for r in split.stratified_split(df.repartition(parts), seed=seed).collect()}
    assert of(42, 3) == of(42, 7)
    assert of(42, 3) != of(43, 3)


def test_split_other_shares_and_errors(spark):
    df = spark.range(200).select(F.col("id").alias("PROTOCOLO"), F.lit(1).alias("TARGET"))
    sizes = Counter(r.split for r in split.stratified_split(df, shares=(0.5, 0.3, 0.2)).collect())
    assert sizes == {"train": 100, "validation": 60, "test": 40}
    with pytest.raises(ValueError):
        split.stratified_split(df, shares=(0.8, 0.1, 0.2))


def test_split_keeps_copies_of_a_key_together(spark):
    """A third of the rows carry one key; they share a split and no row is lost."""
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("PROTOCOLO"), F.lit(0).alias("TARGET")
    )
    placed = split.stratified_split(df)
    assert placed.count() == 900
    assert placed.filter("PROTOCOLO = -1").select("split").distinct().count() == 1


def test_customer_split_has_no_overlap(spark):
    df = spark.range(2000).select(
        F.col("id").alias("PROTOCOLO"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("ID_CLIENTE"),
        (F.col("id") % 50 == 0).cast("int").alias("TARGET"),
    )
    placed = split.customer_split(df)
    assert placed.count() == 2000 and placed.filter("split is null").count() == 0
    assert split.split_overlap(placed).first().overlapping == 0


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_bytes": 0}])
def test_lookup_join_with_a_hot_key(spark, limits):
    facts = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
    )
    lookup = facts.filter("k is not null and k <> 'k5'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = lookup_join(facts, lookup, ["k"], "n", ["id"], **limits)
    want = facts.join(lookup.drop("n"), "k", "left")
    assert got.columns == ["k", "id", "top"]
    assert got.count() == 3000 and got.exceptAll(want.select(*got.columns)).count() == 0


def test_salted_join_spreads_the_hot_key(spark):
    facts = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = lookup_join(facts, lookup, ["k"], "n", ["id"], broadcast_rows=0)
    plan = joined._jdf.queryExecution().toString()
    assert "__salt" in plan
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, n = 4000, 2000
    assert 1 + n * parts // total == 5  # replicas of the hot key


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_auc_against_all_pairs(spark, digits):
    rnd = random.Random(digits)
    rows = [(s, int(rnd.random() < 0.2), round(rnd.random() ** 3, digits)) for s in ("train", "test") for _ in range(300)]
    rows += [("validation", 0, 0.3), ("validation", 0, 0.1)]
    df = spark.createDataFrame(rows, "split string, y int, p double")
    got = {r.split: r.auc_roc for r in M.roc_auc(df).collect()}
    for name in params.SPLITS:
        want = brute_auc([(y, p) for s, y, p in rows if s == name])
        assert got[name] is None if want is None else got[name] == pytest.approx(want, abs=1e-12)


def test_auc_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rnd = random.Random(7)
    df = spark.createDataFrame([("train", int(rnd.random() < 0.3), round(rnd.random(), 3)) for _ in range(2000)], "split string, y int, p double")
    own = M.roc_auc(df).first().auc_roc
    evaluator = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0)
    assert own == pytest.approx(evaluator.evaluate(df), abs=1e-9)


def scored(spark, rows):
    return spark.createDataFrame([("validation", y, p) for y, p in rows], "split string, y int, p double")


def test_metric_edges(spark):
    nothing_predicted = M.evaluate(scored(spark, [(1, 0.1), (0, 0.2)]), 0.5).first()
    assert (nothing_predicted.precision, nothing_predicted.recall, nothing_predicted.f1_score) == (0, 0, 0)
    no_positive = M.evaluate(scored(spark, [(0, 0.9), (0, 0.2)]), 0.5).first()
    assert (no_positive.auc_roc, no_positive.precision, no_positive.recall) == (None, 0, 0)
    equal = M.evaluate(scored(spark, [(1, 0.5), (0, 0.5), (0, 0.5)]), 0.5).first()
    assert (equal.auc_roc, equal.tp, equal.fp) == (0.5, 1, 2)


def test_threshold_ties_and_fallback(spark):
    tied = M.threshold_sweep(scored(spark, [(1, 0.65), (0, 0.05)]))
    assert M.best_threshold(tied).first().threshold == 0.1
    hopeless = M.threshold_sweep(scored(spark, [(0, 0.65), (0, 0.05)]))
    assert M.best_threshold(hopeless).first().threshold == 0.5


def metrics(spark, *rows):
    return spark.createDataFrame([(d, a, 0.9, 0.9, f) for d, a, f in rows], "dataset string, auc_roc double, precision double, recall double, f1_score double")


def test_overfitting_rules(spark):
    table = metrics(spark, ("Train", 0.99, 0.90), ("Validation", 0.98, 0.96), ("Test", 0.97, 0.9541))
    assert M.overfitting_check(table).first().overfitting is False  # signed: validation may be better
    gaps = M.f1_gaps(table).first()
    assert gaps.generalises is False and gaps.train_validation_points == pytest.approx(6)
    assert M.regression_verdict(table, M.stored_metrics(spark)).first().verdict == "same"
    gate = M.acceptance_gate(table).first()
    assert (gate.f1_ok, gate.auc_ok, gate.gap_ok) == (True, False, False)


def test_reports_without_metrics_are_empty(spark):
    from ticketlens.plans import report

    none = metrics(spark, ("train", 0.5, 0.5)).limit(0)
    assert report.headline(none).count() == report.metrics_in_percent(none).count() == 0
    assert report.overfitting_analysis(none).count() == report.run_comparison(none, M.stored_metrics(spark)).count() == 0


def brute_terms(rows, k=4):
    """TF-IDF by definition over repeated rows: smooth idf, unit vectors, mean; rows of (text tokens, repeats)."""
    docs = [words + [f"{a} {b}" for a, b in zip(words, words[1:])] for words, n in rows for _ in range(n)]
    df = Counter(t for d in docs for t in set(d))
    score = defaultdict(float)
    for d in docs:
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            score[t] += x / norm / len(docs)
    return sorted(((t, round(s, 9)) for t, s in score.items()), key=lambda e: (-e[1], e[0]))[:k]


def test_cluster_keywords_against_definition(spark):
    rnd = random.Random(3)
    vocabulary = ["sinal", "conexão", "lenta", "fatura", "boleto", "visita"]
    rows = []
    for cluster in (0, 1):
        for i in range(12):
            rows.append((cluster, f"{cluster}-{i}", " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 5))), rnd.randint(1, 4)))
    rows += [(2, "e", "", 3), (2, "s", "para que", 1), (2, "z", "a", 9), (3, "u", "sinal", 5)]
    texts = spark.createDataFrame(rows, "cluster int, key string, text string, n int")
    got = {r.cluster: r.label for r in clusters.cluster_keywords(texts, ["cluster"], "key").collect()}
    for cluster in (0, 1):
        best = brute_terms([(t.split(), n) for c, _, t, n in rows if c == cluster])
        assert got[cluster] == ", ".join(t for t, _ in best)
    assert got[2] == " | ".join(["", "a"])
    assert got[3] == "sinal"
    ids = spark.range(5).select(F.col("id").cast("int").alias("cluster"))
    named = clusters.label_clusters(ids, clusters.cluster_keywords(texts, ["cluster"], "key"), ["cluster"])
    assert named.filter("cluster = 4").first().label == "cluster_vazio"


def test_profiles(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 5.0), (None, None)], "ID_CLIENTE int, v double")
    row = profile.customer_duplicates(df).first()
    assert (row.rows, row.customers, row.surplus, row.mean_rows) == (4, 2, 2, 2.0)
    assert profile.customer_duplicates(df.drop("ID_CLIENTE")).count() == 0
    check = profile.identifier_check(df, "v").first()
    assert (check["values"], check.single_customer_values, check.max_customers) == (2, 1, 2)


def test_drift_of_equal_and_shifted(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "validation").otherwise("test").alias("split"),
        F.when(F.col("id") % 3 == 2, 900 + F.col("id") % 100).otherwise(F.floor(F.col("id") / 3) % 1000).alias("x"),
    )
    psi = {r.split: r.psi for r in profile.drift(df, ["x"]).collect()}
    assert psi["train"] == 0 and psi["validation"] == pytest.approx(0, abs=1e-9) and psi["test"] > 1


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, "ação"), ("test", 2, None)], "split string, k int, t string")
    path = T.write_splits(df, str(tmp_path / "splits"))
    assert T.check_splits(T.read_splits(spark, path)) == ["train", "test"]
    assert T.read_splits(spark, path, ["test"]).count() == 1
    with pytest.raises(ValueError):
        T.splits_present(df.filter("split = 'test'"))
    csv = T.write_table(df, str(tmp_path / "t.csv"))
    back = T.read_table(spark, csv, schema=df.schema)
    assert back.exceptAll(df).count() == 0 and back.count() == 2
    with pytest.raises(ValueError):
        T.read_table(spark, csv)


def test_term_scores_slice_by_slice(spark, monkeypatch):
    """Terms weighed in slices score as at once; each slice is written before the next one is sent, hot terms and a missing key included."""
    texts = spark.range(400).selectExpr(
        "CAST(id % 2 AS int) AS cluster", "CASE WHEN id > 0 THEN id END AS key", "1 + id % 3 AS n",
        "concat('sinal ', 'rede', id % 7, ' cabo', id % 11, ' sinal fibra', id, CASE WHEN id % 5 = 0 THEN ' modem' ELSE '' END) AS text",
    )
    names, write = [], clusters.written

    def recorded(df, name="table", *rest):
        names.append(name)
        return write(df, name, *rest)

    def scores():
        return {(r.cluster, r.term): r.score for r in clusters.term_scores(texts, ["cluster"], "key").collect()}

    monkeypatch.setattr(clusters, "written", recorded)
    at_once = scores()
    assert "scores" not in names
    monkeypatch.setattr(clusters, "SLICE_BYTES", 100)
    sliced = scores()
    assert names.count("scores") == clusters.SLICES and names.count("lengths") == clusters.SLICES + 1
    assert sliced == pytest.approx(at_once, rel=1e-12) and len(sliced) > 800
    words = {(r.cluster, r.words) for r in texts.selectExpr("cluster", "split(text, ' ') AS words").selectExpr("cluster", "explode(words) AS words").collect()}
    assert words <= set(sliced)
