"""Queries: decisions, metrics, thresholds and report tables over scored tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params
from ticketlens.catalog.oracle_parts import metrics_view
from ticketlens.catalog.registry import query
from ticketlens.catalog.tables import metrics_at, rounded
from ticketlens.operators import calibration
from ticketlens.operators import metrics as M
from ticketlens.plans import report

_METRICS = ("auc_roc", "precision", "recall", "f1_score")
_R6 = ", ".join(f"round({n}, 6) AS {n}" for n in _METRICS)


@query(
    "P19_apply_threshold",
    f"{X.oracle_views('scored')} SELECT PROTOCOLO, CAST(p >= CAST(0.6 AS DOUBLE) AS INTEGER) AS prediction FROM scored",
)
def apply_threshold(spark, sf_dir):
    return M.decide(X.scored(spark, sf_dir), 0.6).select("PROTOCOLO", "prediction")


@query("E1_confusion_counts", f"{metrics_view()} SELECT split, tn, fp, fn, tp FROM conf")
def confusion_counts(spark, sf_dir):
    return M.confusion(X.scored(spark, sf_dir), 0.6)


@query("E2_roc_auc", f"{metrics_view()} SELECT split, round(auc_roc, 9) AS auc_roc FROM auc")
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(X.scored(spark, sf_dir)), "auc_roc", digits=9)


@query(
    "E3_precision_recall_f1",
    f"""{metrics_view(0.5)}, c AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM conf)
SELECT round(CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE), 6) AS precision, round(CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE), 6) AS recall,
  round(CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1_score FROM c""",
)
def precision_recall_f1(spark, sf_dir):
    c = M.confusion(X.scored(spark, sf_dir), 0.5, by=())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rounded(
        c.select(M.precision(tp, fp).alias("precision"), M.recall(tp, fn).alias("recall"), M.f1(tp, fp, fn).alias("f1_score")),
        "precision", "recall", "f1_score",
    )


@query("E4_metrics_per_split", f"{metrics_view()} SELECT dataset, {_R6} FROM metrics")
def metrics_per_split(spark, sf_dir):
    return rounded(metrics_at(spark, sf_dir), *_METRICS)


_SWEEP = f"""{X.oracle_views("scored")},
t AS (SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM range(1, 8) r(i)),
c AS (SELECT split, threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
  count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM scored, t GROUP BY ALL),
sweep AS (SELECT split, threshold, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1_score,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall FROM c)"""


@query(
    "E5_threshold_sweep",
    f"{_SWEEP} SELECT split, threshold, round(f1_score, 6) AS f1_score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep",
)
def threshold_sweep(spark, sf_dir):
    return rounded(M.threshold_sweep(X.scored(spark, sf_dir)), "f1_score", "precision", "recall")


@query(
    "O5_best_threshold",
    f"""{_SWEEP} SELECT CASE WHEN f1_score > 0 THEN threshold ELSE 0.5 END AS threshold, round(f1_score, 6) AS f1_score
FROM sweep WHERE split = 'validation' ORDER BY sweep.f1_score DESC, sweep.threshold LIMIT 1""",
)
def best_threshold(spark, sf_dir):
    validation = X.scored(spark, sf_dir).filter(F.col("split") == "validation")
    return rounded(M.best_threshold(M.threshold_sweep(validation)), "f1_score")


def _side(dataset: str, metric: str) -> str:
    return f"(SELECT {metric} FROM metrics WHERE dataset = '{dataset}')"


_DELTA_AUC = f"{_side('train', 'auc_roc')} - {_side('validation', 'auc_roc')}"
_DELTA_F1 = f"{_side('train', 'f1_score')} - {_side('validation', 'f1_score')}"


@query(
    "E6_overfitting_check",
    f"""{metrics_view()} SELECT round({_DELTA_AUC}, 6) AS delta_auc, round({_DELTA_F1}, 6) AS delta_f1,
  ({_DELTA_AUC}) > 0.05 OR ({_DELTA_F1}) > 0.05 AS overfitting""",
)
def overfitting_check(spark, sf_dir):
    return rounded(M.overfitting_check(metrics_at(spark, sf_dir)), "delta_auc", "delta_f1")


@query(
    "E7_detected_and_missed",
    f"""{metrics_view()} SELECT split, tp + fn AS positives, tp AS detected, fn AS missed, round(tp * 100.0 / (tp + fn), 6) AS detected_pct,
  round(fn * 100.0 / (tp + fn), 6) AS missed_pct FROM conf""",
)
def detected_and_missed(spark, sf_dir):
    return rounded(M.detection(X.scored(spark, sf_dir), 0.6), "detected_pct", "missed_pct")


_GAP_1 = f"abs({_DELTA_F1}) * 100"
_GAP_2 = f"abs({_side('validation', 'f1_score')} - {_side('test', 'f1_score')}) * 100"


@query(
    "E8_f1_gaps",
    f"""{metrics_view()} SELECT round({_GAP_1}, 6) AS train_validation_points, round({_GAP_2}, 6) AS validation_test_points,
  {_GAP_1} < 3.0 AS generalises""",
)
def f1_gaps(spark, sf_dir):
    return rounded(M.f1_gaps(metrics_at(spark, sf_dir)), "train_validation_points", "validation_test_points")


@query(
    "E9_regression_verdict",
    f"""{metrics_view()}, d AS (SELECT abs(f1_score - s_f1_score) AS gap FROM metrics JOIN stored USING (dataset) WHERE dataset = 'test')
SELECT round(gap, 6) AS f1_difference, CASE WHEN gap < 0.001 THEN 'same' WHEN gap < 0.01 THEN 'close' ELSE 'different' END AS verdict FROM d""",
)
def regression_verdict(spark, sf_dir):
    return rounded(M.regression_verdict(metrics_at(spark, sf_dir), M.stored_metrics(spark)), "f1_difference")


@query(
    "E10_acceptance_gate",
    f"""{metrics_view()} SELECT {_side('test', 'f1_score')} >= 0.95 AS f1_ok, {_side('test', 'auc_roc')} >= 0.99 AS auc_ok,
  {_GAP_1} < 3.0 AS gap_ok""",
)
def acceptance_gate(spark, sf_dir):
    return M.acceptance_gate(metrics_at(spark, sf_dir))


_PCT = ", ".join(f"round({n} * 100, 2) AS {n}_pct" for n in ("f1_score", "auc_roc", "precision", "recall"))


@query("R1_headline", f"{metrics_view()} SELECT dataset, {_PCT} FROM metrics WHERE dataset = 'test'")
def headline(spark, sf_dir):
    return report.headline(metrics_at(spark, sf_dir))


@query("R2_metrics_in_percent", f"{metrics_view()} SELECT dataset, {_PCT} FROM metrics")
def metrics_in_percent(spark, sf_dir):
    return report.metrics_in_percent(metrics_at(spark, sf_dir))


@query(
    "R3_overfitting_analysis",
    f"""{metrics_view()} SELECT round({_GAP_1}, 2) AS train_validation_points, round({_GAP_2}, 2) AS validation_test_points,
  {_GAP_1} < 3.0 AS generalises""",
)
def overfitting_analysis(spark, sf_dir):
    return report.overfitting_analysis(metrics_at(spark, sf_dir))


_LEVELS = " UNION ALL ".join(
    f"SELECT 'TAB_N{i}' AS tab, TAB_N{i}_GROUP AS semantic_group, TAB_N{i}_SENT_LABEL AS mood FROM tickets_semantic" for i in (1, 2, 3)
)


@query(
    "R5_cluster_statistics",
    f"""{X.oracle_views('tickets_semantic')}, long AS ({_LEVELS}),
m AS (SELECT tab, semantic_group, mood, count(*) AS c FROM long WHERE semantic_group IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tab, semantic_group ORDER BY c DESC, mood) AS rn,
  sum(c) OVER (PARTITION BY tab, semantic_group) AS texts FROM m)
SELECT tab, semantic_group, CAST(texts AS BIGINT) AS texts, len(string_split(semantic_group, ', ')) AS n_keywords,
  array_to_string(string_split(semantic_group, ', '), '|') AS keywords, mood AS dominant_sentiment,
  CAST(sum(texts) OVER (PARTITION BY tab) AS BIGINT) AS tab_texts, count(*) OVER (PARTITION BY tab) AS tab_clusters
FROM r WHERE rn = 1""",
)
def cluster_statistics(spark, sf_dir):
    stats = report.semantic_clusters(X.tickets_semantic(spark, sf_dir))
    return stats.select(
        "tab", "semantic_group", "texts", F.size("keywords").cast("long").alias("n_keywords"),
        F.array_join("keywords", "|").alias("keywords"), "dominant_sentiment", "tab_texts", "tab_clusters",
    )


_LEVEL_IDS = {"TAB_N1": 4, "TAB_N2": 5, "TAB_N3": 10}
_LEVELS_BY_ID = " UNION ALL ".join(
    f"SELECT '{tab}' AS tab, CAST(PROTOCOLO % {k} AS INTEGER) AS cluster_id, {tab}_GROUP AS semantic_group, {tab}_SENT_LABEL AS mood "
    "FROM tickets_semantic"
    for tab, k in _LEVEL_IDS.items()
)


@query(
    "R5_clusters_of_one_label",
    f"""{X.oracle_views('tickets_semantic')}, long AS ({_LEVELS_BY_ID}),
m AS (SELECT tab, cluster_id, semantic_group, mood, count(*) AS c FROM long WHERE semantic_group IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tab, cluster_id, semantic_group ORDER BY c DESC, mood) AS rn,
  sum(c) OVER (PARTITION BY tab, cluster_id, semantic_group) AS texts FROM m)
SELECT tab, cluster_id, semantic_group, CAST(texts AS BIGINT) AS texts, mood AS dominant_sentiment,
  CAST(sum(texts) OVER (PARTITION BY tab) AS BIGINT) AS tab_texts, count(*) OVER (PARTITION BY tab) AS tab_clusters
FROM r WHERE rn = 1""",
)
def clusters_of_one_label(spark, sf_dir):
    """Clusters by id: two of the second level have one label."""
    ids = {f"{tab}{params.CLUSTER_SUFFIX}": (F.col("PROTOCOLO") % k).cast("int") for tab, k in _LEVEL_IDS.items()}
    return report.semantic_clusters(X.tickets_semantic(spark, sf_dir).withColumns(ids)).drop("keywords")


_COMPARED = (
    "dataset, "
    + ", ".join(f"round({n}, 6) AS {n}, s_{n} AS stored_{n}, round({n} - s_{n}, 6) AS delta_{n}" for n in _METRICS)
)


def _compare(spark, sf_dir):
    table = report.run_comparison(metrics_at(spark, sf_dir), M.stored_metrics(spark))
    return rounded(table, *_METRICS, *[f"delta_{n}" for n in _METRICS])


@query("J4_compare_runs", f"{metrics_view()} SELECT {_COMPARED} FROM metrics JOIN stored USING (dataset)")
def compare_runs(spark, sf_dir):
    return _compare(spark, sf_dir)


@query(
    "R6_run_comparison",
    f"""{metrics_view()}, long AS (UNPIVOT (SELECT dataset, auc_roc, precision, recall, f1_score FROM metrics)
  ON auc_roc, precision, recall, f1_score INTO NAME metric VALUE current),
before AS (UNPIVOT (SELECT dataset, s_auc_roc AS auc_roc, s_precision AS precision, s_recall AS recall, s_f1_score AS f1_score FROM stored)
  ON auc_roc, precision, recall, f1_score INTO NAME metric VALUE stored_value)
SELECT dataset, metric, round(current, 6) AS current, stored_value, round(current - stored_value, 6) AS delta
FROM long JOIN before USING (dataset, metric)""",
)
def run_comparison(spark, sf_dir):
    table = report.run_comparison_long(metrics_at(spark, sf_dir), M.stored_metrics(spark))
    return rounded(table, "current", "delta")


@query(
    "M16_calibrated_probability",
    f"""{X.oracle_views('scored')}, pts AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) AS n, sum(y) AS s FROM scored WHERE split = 'validation' GROUP BY p),
cum AS (SELECT i, p, sum(n) OVER (ORDER BY i) AS cn, sum(s) OVER (ORDER BY i) AS cs, n, s FROM pts),
spans AS (SELECT a.i AS j, b.i AS k, CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM cum a JOIN cum b ON a.i <= b.i),
least_ AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM spans),
fit AS (SELECT i, max(m) AS calibrated FROM least_ GROUP BY i)
SELECT p, n AS rows, round(calibrated, 9) AS calibrated FROM fit JOIN pts USING (i)""",
)
def calibrated_probability(spark, sf_dir):
    """Isotonic fit on the validation scores, at each of them: the highest of the lowest means of all spans around a score."""
    validation = X.scored(spark, sf_dir).filter(F.col("split") == "validation").select("p", "y")
    points = validation.groupBy("p").agg(F.count("*").alias("rows"))
    fitted = calibration.fit_calibration(validation)
    return rounded(calibration.calibrate(fitted, points.select("p", "rows", F.col("p").alias("calibrated")), "calibrated"), "calibrated", digits=9)
