"""Evaluation of scored rows (split, y, p). All of it starts from one aggregate by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import params, schemas
from ticketlens.runtime import local_table, shuffle_parts


def decide(scored: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Add the 0/1 decision: probability at or above the threshold."""
    return scored.withColumn("prediction", (F.col(p) >= F.lit(float(threshold))).cast("int"))


def ratio(x: Column, y: Column) -> Column:
    """x / y, and 0 where y is 0."""
    return F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def confusion(scored: DataFrame, threshold: float, by: Sequence[str] = ("split",)) -> DataFrame:
    """True and false negatives and positives at a threshold."""
    hit, positive = F.col("p") >= F.lit(float(threshold)), F.col("y") == 1
    return scored.groupBy(*by).agg(
        _count(~hit & ~positive).alias("tn"),
        _count(hit & ~positive).alias("fp"),
        _count(~hit & positive).alias("fn"),
        _count(hit & positive).alias("tp"),
    )


def _score_bands(scored: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Per group and band of scores: class counts, hits, and the pairs ranked right within the band.

    Rows of equal score collapse first, so a score held by very many rows is one row afterwards. Bands end at
    quantiles of the scores; a band holds a bounded share of the distinct scores whatever their distribution,
    and is ordered by one task. Bands are put together afterwards from their totals.
    """
    bands = max(8, shuffle_parts(scored.sparkSession))
    edges = scored.agg(F.percentile_approx("p", [i / bands for i in range(1, bands)], max(10_000, 10 * bands))).scalar()
    positive = (F.col("y") == 1).cast("long")
    by_score = scored.groupBy(*by, "p").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    banded = by_score.withColumn("edges", edges).withColumn(
        "band", F.size(F.filter("edges", lambda edge: edge < F.col("p")))
    )
    below = Window.partitionBy(*by, "band").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("p") >= F.lit(float(threshold))
    return (
        banded.withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
        .groupBy(*by, "band")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2)).alias("ranked"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        )
    )


def evaluate(scored: DataFrame, threshold: float, by: Sequence[str] = ("split",)) -> DataFrame:
    """Confusion counts, exact ROC AUC (ties count half), precision, recall and F1 per group.

    AUC is null for a group of one class.
    """
    by = list(by)
    below = Window.partitionBy(*by).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = _score_bands(scored, by, threshold).withColumn(
        "neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0)).cast("double")
    )
    totals = bands.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("ranked") + F.col("pos") * F.col("neg_below")).alias("ranked"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("positives") - tp
    pairs = F.nullif(F.col("positives").cast("double") * F.col("negatives"), F.lit(0.0))
    return totals.select(
        *by,
        (F.col("negatives") - fp).alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        tp.alias("tp"),
        (F.col("ranked") / pairs).alias("auc_roc"),
        precision(tp, fp).alias("precision"),
        recall(tp, fn).alias("recall"),
        f1(tp, fp, fn).alias("f1_score"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    return evaluate(scored, params.FALLBACK_THRESHOLD, by).select(*by, "auc_roc")


def metrics_table(scored: DataFrame, threshold: float) -> DataFrame:
    """The metrics of each split, one row per dataset."""
    return evaluate(scored, threshold).select(
        F.col("split").alias("dataset"), "auc_roc", "precision", "recall", "f1_score"
    )


def threshold_sweep(
    scored: DataFrame,
    thresholds: Sequence[float] = tuple(params.DECISION_THRESHOLDS),
    by: Sequence[str] = ("split",),
) -> DataFrame:
    """F1, precision and recall at each threshold. One pass: the counts of all thresholds are one aggregate."""
    positive = F.col("y") == 1
    counts = []
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= F.lit(float(t))
        counts += [_count(hit & positive).alias(f"tp_{i}"), _count(hit & ~positive).alias(f"fp_{i}")]
    wide = scored.groupBy(*by).agg(_count(positive).alias("positives"), *counts)
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"))
            for i, t in enumerate(thresholds)
        ]
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("positives") - tp
    return wide.select(*by, "positives", F.inline(rows)).select(
        *by,
        "threshold",
        f1(tp, fp, fn).alias("f1_score"),
        precision(tp, fp).alias("precision"),
        recall(tp, fn).alias("recall"),
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the highest F1, the lowest among equals; 0.5 if no F1 is above 0."""
    best = F.max(F.struct("f1_score", (-F.col("threshold")).alias("minus_threshold")))
    chosen = sweep.groupBy(*by).agg(best.alias("best"))
    f1_score = F.col("best.f1_score")
    return chosen.select(
        *by,
        F.when(f1_score > 0, -F.col("best.minus_threshold")).otherwise(F.lit(params.FALLBACK_THRESHOLD)).alias("threshold"),
        F.greatest(f1_score, F.lit(0.0)).alias("f1_score"),
    )


def detection(scored: DataFrame, threshold: float, by: Sequence[str] = ("split",)) -> DataFrame:
    """Positives found and missed, in rows and percent."""
    tp, fn = F.col("tp"), F.col("fn")
    return confusion(scored, threshold, by).select(
        *by,
        (tp + fn).alias("positives"),
        tp.alias("detected"),
        fn.alias("missed"),
        (tp * 100.0 / F.nullif(tp + fn, F.lit(0))).alias("detected_pct"),
        (fn * 100.0 / F.nullif(tp + fn, F.lit(0))).alias("missed_pct"),
    )


def _of(dataset: str, metric: str) -> Column:
    return F.max(F.when(F.lower("dataset") == dataset, F.col(metric)))


def overfitting_check(metrics: DataFrame) -> DataFrame:
    """Signed train-minus-validation gaps; either above the limit means overfitting. Empty without metrics."""
    gaps = metrics.agg(
        F.count("*").alias("datasets"),
        (_of("train", "auc_roc") - _of("validation", "auc_roc")).alias("delta_auc"),
        (_of("train", "f1_score") - _of("validation", "f1_score")).alias("delta_f1"),
    )
    gaps = gaps.filter("datasets > 0").drop("datasets")
    limit = F.lit(params.OVERFIT_DELTA)
    over = (F.col("delta_auc") > limit) | (F.col("delta_f1") > limit)
    return gaps.withColumn("overfitting", F.coalesce(over, F.lit(False)))


def f1_gaps(metrics: DataFrame) -> DataFrame:
    """Absolute F1 gaps in percentage points, and the verdict on the first. Empty without metrics."""
    train, validation, test = (_of(name, "f1_score") for name in params.SPLITS)
    gaps = metrics.agg(
        F.count("*").alias("datasets"),
        (F.abs(train - validation) * 100).alias("train_validation_points"),
        (F.abs(validation - test) * 100).alias("validation_test_points"),
    ).filter(F.col("datasets") > 0)
    return gaps.drop("datasets").withColumn(
        "generalises", F.col("train_validation_points") < F.lit(params.OVERFIT_POINTS)
    )


def acceptance_gate(metrics: DataFrame) -> DataFrame:
    """The three numeric acceptance criteria, each as a boolean. Empty without metrics."""
    values = metrics.agg(
        F.count("*").alias("datasets"),
        _of("test", "f1_score").alias("test_f1"),
        _of("test", "auc_roc").alias("test_auc"),
        (F.abs(_of("train", "f1_score") - _of("validation", "f1_score")) * 100).alias("gap"),
    )
    return values.filter("datasets > 0").select(
        (F.col("test_f1") >= params.GATE_F1).alias("f1_ok"),
        (F.col("test_auc") >= params.GATE_AUC).alias("auc_ok"),
        (F.col("gap") < params.OVERFIT_POINTS).alias("gap_ok"),
    )


def stored_metrics(spark, rows: Sequence[tuple] = tuple(params.STORED_METRICS)) -> DataFrame:
    return local_table(spark, list(rows), schemas.METRICS)


def compare_runs(metrics: DataFrame, stored: DataFrame) -> DataFrame:
    """Current and stored metrics of each dataset of either run side by side, with their differences.

    Empty without current metrics.
    """
    names = ("auc_roc", "precision", "recall", "f1_score")
    key = F.lower("dataset")
    current = metrics.select(key.alias("dataset"), *names)
    before = stored.select(key.alias("dataset"), *[F.col(n).alias(f"stored_{n}") for n in names])
    any_current = current.agg(F.count(F.lit(1)) > 0).scalar()
    return current.join(before, "dataset", "full").filter(any_current).select(
        "dataset",
        *names,
        *[f"stored_{n}" for n in names],
        *[(F.col(n) - F.col(f"stored_{n}")).alias(f"delta_{n}") for n in names],
    )


def regression_verdict(metrics: DataFrame, stored: DataFrame) -> DataFrame:
    """Does the test F1 repeat the stored one?"""
    gap = F.abs("delta_f1_score")
    return (
        compare_runs(metrics, stored)
        .filter(F.col("dataset") == "test")
        .select(
            gap.alias("f1_difference"),
            F.when(gap < params.SAME_RUN, "same").when(gap < params.CLOSE_RUN, "close").otherwise("different").alias("verdict"),
        )
    )
