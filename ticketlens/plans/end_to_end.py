"""The whole run: prepare, enrich, describe, train, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.operators import metrics as M
from ticketlens.operators.encoders import fit_hashed_tfidf
from ticketlens.operators.features import DEFAULT_BLOCKS, build_features, occurrences
from ticketlens.operators.metrics import stored_metrics
from ticketlens.operators.prepare import prepare
from ticketlens.operators.semantics import SemanticModel, TextLevel, enrich, save_semantics
from ticketlens.operators.training import TrainingRun, rank_importances, save_model, train
from ticketlens.plans import report
from ticketlens.runtime import dealt, pinned
from ticketlens.sources.tables import read_splits, splits_present, write_cluster_json, write_importances, write_splits, write_table


@dataclass(frozen=True)
class Run:
    enriched: DataFrame
    semantics: SemanticModel
    features: DataFrame
    training: TrainingRun
    reports: dict[str, DataFrame]


def indicators(features: DataFrame) -> list[str]:
    """Indicator columns of a feature table, built-in or of own blocks."""
    return [c for c in features.columns if c.startswith(("count_", "prop_", "flag_")) and not c.endswith("_total")]


def report_tables(
    training: TrainingRun, enriched: DataFrame, features: DataFrame | None = None, tabs: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """All report tables. With the feature table also how often each indicator occurs: one that never fires shows as 0."""
    metrics = training.metrics
    stored = stored_metrics(enriched.sparkSession)
    tables = {
        "overfitting_check": M.overfitting_check(metrics),
        "confusion": M.confusion(training.scored, training.threshold),
        "top_importances": rank_importances(training.importances, 15),
        "acceptance": M.acceptance_gate(metrics),
        "verdict": M.regression_verdict(metrics, stored),
        "splits": splits_present(enriched),
        "labels": enriched.groupBy(params.LABEL).agg(F.count("*").alias("rows")),
        "comparison_long": report.run_comparison_long(metrics, stored),
    }
    if features is not None:
        tables["occurrences"] = occurrences(features, indicators(features))
    return tables | {
        "headline": report.headline(metrics),
        "metrics": report.metrics_in_percent(metrics),
        "overfitting": report.overfitting_analysis(metrics),
        "importances": report.feature_importances(training.importances),
        "clusters": report.semantic_clusters(enriched, tabs),
        "comparison": report.run_comparison(metrics, stored),
    }


def run_from_splits(
    split_table: DataFrame,
    levels: Sequence[TextLevel] | None = None,
    fit_encoder: Callable = fit_hashed_tfidf,
    with_report: bool = False,
    output: str | None = None,
    blocks: Sequence[Callable] = DEFAULT_BLOCKS,
    null_text: str = "nan",
    salt_by: Sequence[str] | None = None,
    **settings,
) -> Run:
    """From existing splits: enrich, describe, train. With ``output`` the results are written below that path.

    The enriched table is written once (to the output, else as a checkpoint); features are one projection over it,
    and the training reads a checkpointed matrix, so no stage is computed twice.
    """
    spark = split_table.sparkSession
    semantics, enriched = enrich(split_table, levels, fit_encoder, null_text, salt_by)
    if output:
        write_splits(enriched, f"{output}/enriched")
        enriched = read_splits(spark, f"{output}/enriched")
        if semantics.levels:
            save_semantics(semantics, spark, f"{output}/semantics")
        write_table(semantics.cluster_dictionary(spark), f"{output}/cluster_dictionary")
        write_cluster_json(semantics.cluster_dictionary(spark), f"{output}/cluster_json")
    else:
        enriched = pinned(enriched)
    features = build_features(enriched, blocks)
    training = train(features, **settings)
    if output:
        save_model(training.model, f"{output}/model")
        write_table(training.metrics, f"{output}/metrics")
        write_importances(training.importances, f"{output}/importances")
    reports = report_tables(training, enriched, features, list(semantics.levels)) if with_report else {}
    if output:
        for name, table in reports.items():
            write_table(table, f"{output}/report/{name}")
    return Run(enriched, semantics, features, training, reports)


def run(
    tickets: DataFrame,
    key: str = params.TICKET,
    seed: int = params.SEED,
    levels: Sequence[TextLevel] | None = None,
    fit_encoder: Callable = fit_hashed_tfidf,
    output: str | None = None,
    **settings,
) -> Run:
    """From raw tickets to model and report. ``settings``: ``blocks``, ``null_text``, ``salt_by``, and what ``train`` takes.

    Tickets stored in fewer parts than there are cores are dealt to all cores first, so that no later step leaves cores idle.
    """
    prepared = prepare(dealt(tickets), key, seed)
    if output:
        write_splits(prepared, f"{output}/splits")
        prepared = read_splits(tickets.sparkSession, f"{output}/splits")
    return run_from_splits(prepared, levels, fit_encoder, with_report=True, output=output, **settings)
