"""From the raw ticket table to a labelled, split one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.operators.split import stratified_split


def add_target(df: DataFrame, source: str = params.LABEL_SOURCE, label: str = params.LABEL) -> DataFrame:
    """1 where the customer has a cancellation, else 0."""
    if source not in df.columns:
        raise ValueError(f"column {source} is needed to make the label")
    return df.withColumn(label, F.col(source).isNotNull().cast("int"))


def drop_leaks(df: DataFrame, columns: Iterable[str] = params.LEAK_COLUMNS) -> DataFrame:
    """Drop identifiers and columns that give the label away; absent ones are ignored."""
    return df.drop(*columns)


def prepare(
    df: DataFrame,
    key: str = params.TICKET,
    seed: int = params.SEED,
    shares: tuple[float, float, float] = params.SPLIT_SHARES,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Label, split and drop. ``keep`` names leak columns to carry along, for example the key."""
    split = stratified_split(add_target(df), params.LABEL, key, seed, shares)
    return drop_leaks(split, [c for c in params.LEAK_COLUMNS if c not in set(keep)])
