"""Scoring of new tickets as they arrive.

The steps from a ticket to its probability are stateless, so a batch and a stream share the functions. What is kept is which tickets
were seen (a repeated ticket is scored once) and how far the stream has come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ticketlens.functions.times import event_time
from ticketlens.operators.features import build_features
from ticketlens.operators.semantics import SemanticModel, read_semantics, write_semantics
from ticketlens.operators.training import feature_matrix, predict
from ticketlens.runtime import evened, pinned
from ticketlens.sources.published import current, publish
from ticketlens.sources.tables import nan_to_null

_AT = "__at"


def save_scorer(semantics: SemanticModel, model: PipelineModel, spark: SparkSession, path: str) -> int:
    """Publish text levels and trees together, as one version: a stream never meets the one of a fit and the other of another."""

    def write(folder: str) -> None:
        write_semantics(semantics, spark, f"{folder}/semantics")
        model.save(f"{folder}/model")

    return publish(spark, path, write)


def load_scorer(spark: SparkSession, path: str, encoder: object | None = None) -> tuple[SemanticModel, PipelineModel]:
    """Text levels and trees of the last published version; ``encoder`` for levels whose encoder holds code."""
    folder = current(spark, path)
    return read_semantics(spark, f"{folder}/semantics", encoder=encoder), PipelineModel.load(f"{folder}/model")


def ticket_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, files_per_trigger: int = 1_000
) -> DataFrame:
    """Parquet files as they land in a folder; ``pattern`` limits the file names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return nan_to_null(reader.parquet(path))


def score_tickets(
    df: DataFrame, semantics: SemanticModel, model: PipelineModel, label: str, carry: list[str]
) -> DataFrame:
    """Raw tickets to probabilities. ``label`` may be a constant column for unlabelled tickets.

    A stream is scored row by row. In a batch each distinct text is encoded once, so that a text of very many tickets costs no more than one.
    """
    if df.isStreaming:
        described = semantics.transform_rows(df)
    else:
        tickets = evened(pinned(df))
        described = semantics.transform(tickets, carry)
    return predict(model, feature_matrix(build_features(described), label, carry), carry)


def distinct_tickets(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each ticket; a repetition more than ``delay`` after it, by the latest time seen, counts as new. Rows without a key are one."""
    timed = stream.withColumn(_AT, event_time(stream, time)).withWatermark(_AT, delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop(_AT)


def write_batches(output: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes each batch to a folder of its own number.

    A batch that is run again after a failure replaces what it had written, so no row is doubled, and none is lost.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return write


def score_stream(
    stream: DataFrame,
    semantics: SemanticModel,
    model: PipelineModel,
    output: str,
    checkpoint: str,
    label: str,
    key: str,
    time: str,
    delay: str = "1 day",
    carry: list[str] | None = None,
    write: Callable[[str, Callable[[DataFrame], DataFrame]], Callable[[DataFrame, int], None]] = write_batches,
) -> StreamingQuery:
    """Raw tickets to probabilities, each ticket once, what is there is processed and the query stops.

    Start it again with the same ``checkpoint`` for what has come since, or after a failure. The result is the table at ``output``, partitioned
    by batch. A ticket without a time is scored too.
    """
    def scored(batch: DataFrame) -> DataFrame:
        return score_tickets(batch, semantics, model, label, carry or [key])

    query = (
        distinct_tickets(stream, key, time, delay)
        .writeStream.foreachBatch(write(output, scored))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_available(
    stream: DataFrame, output: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Process what is there, append the result as Parquet, stop."""
    result = transform(stream) if transform else stream
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
    return query
