"""The report as tables. Without metrics a table is empty, not an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.operators import metrics as M
from ticketlens.operators.clusters import cluster_statistics
from ticketlens.operators.training import explain_importances

_METRICS = ("f1_score", "auc_roc", "precision", "recall")


def _percent(name: str):
    return F.round(F.col(name) * 100, 2).alias(f"{name}_pct")


def headline(metrics: DataFrame) -> DataFrame:
    """Test metrics in percent."""
    return metrics.filter(F.lower("dataset") == "test").select("dataset", *[_percent(n) for n in _METRICS])


def metrics_in_percent(metrics: DataFrame) -> DataFrame:
    return metrics.select("dataset", *[_percent(n) for n in _METRICS])


def overfitting_analysis(metrics: DataFrame) -> DataFrame:
    gaps = M.f1_gaps(metrics)
    return gaps.select(
        F.round("train_validation_points", 2).alias("train_validation_points"),
        F.round("validation_test_points", 2).alias("validation_test_points"),
        "generalises",
    )


def feature_importances(table: DataFrame, top: int | None = None) -> DataFrame:
    """Ranked importances with their kind."""
    return explain_importances(table, top)


def semantic_clusters(enriched: DataFrame, tabs: Sequence[str] | None = None) -> DataFrame:
    """Clusters of the given text levels, or of all the table has."""
    present = [c.removesuffix("_GROUP") for c in enriched.columns if c.endswith("_GROUP")]
    return cluster_statistics(enriched, list(tabs) if tabs is not None else present)


def run_comparison(metrics: DataFrame, stored: DataFrame) -> DataFrame:
    return M.compare_runs(metrics, stored)


def run_comparison_long(metrics: DataFrame, stored: DataFrame) -> DataFrame:
    """The comparison with a row per dataset and metric."""
    cells = [
        F.struct(
            F.lit(n).alias("metric"),
            F.col(n).alias("current"),
            F.col(f"stored_{n}").alias("stored_value"),
            F.col(f"delta_{n}").alias("delta"),
        )
        for n in ("auc_roc", "precision", "recall", "f1_score")
    ]
    return M.compare_runs(metrics, stored).select("dataset", F.inline(F.array(*cells)))
