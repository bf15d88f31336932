"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Every source has a weight at the start and at the end of training, linear in between. The integral of the schedule is the source's share
of all training tokens. A source may not be repeated more than ``max_epochs`` times: what is above goes to the others by their integrals.
A source's documents form an endless stream in the order of a hash, one epoch after another, and the stream is cut at the target.
The number of tokens of the stream before a document, put into the inverse of the source's cumulative demand, is the training position
(0 to 1) of that copy; sorting by it interleaves the sources as the schedule says.

Defined results: null text has size 0, and such a document starts like others where less than the target is before it; a null source is a source of its own, after the others; a source of size 0 has target 0
and none of its documents is taken;
repeated rows count each (equal keys go by size); other columns of the input are kept out of the way and not returned; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import n_words, running_totals
from ticketlens.runtime import bounded, written

#: Weight at the start and at the end of training of the first, second, third source, and so on in turn; integrals 1, 2, 3.
SCHEDULE = ((0.5, 1.5), (2.0, 2.0), (4.5, 1.5))
MAX_EPOCHS = 3


def sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """What the mix needs of each document: id, source, number of words, hash key; and columns carried along."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *carried)


def source_targets(rows: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, schedule, integral ``weight``, and ``target`` with the excess of capped sources given to the others.

    A source is capped when the level (what is left, per weight that is left) reaches its cap; in the order of cap per weight the capped
    ones come first, so two running sums give the level. The windows run over one row per source.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedule)
    start, end = (F.element_at(F.array(*[F.lit(float(p[i])) for p in schedule]), F.col("_at") + 1) for i in (0, 1))
    sources = sources.withColumn("_at", at).withColumn("w_start", start).withColumn("w_end", end)
    sources = sources.withColumn("weight", (F.col("w_start") + F.col("w_end")) / 2).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything)
    sources = sources.withColumn("_left", total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_rest", F.sum("weight").over(rest))
    sources = sources.withColumn("_capped", F.col("weight") * F.col("_left") >= F.col("cap") * F.col("_rest"))
    open_left = total - F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_rest = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("_capped"), F.col("cap")).otherwise(open_left * F.col("weight") / open_rest)
    return sources.select("source", "source_size", "w_start", "w_end", "weight", target.alias("target"))


def position(share: Column, start: Column, end: Column) -> Column:
    """Training time at which the source's demand reaches ``share`` of its target: inverse of the integrated linear schedule."""
    return F.when(share <= 0, 0.0).otherwise((start + end) * share / (start + F.sqrt(start * start + (end * end - start * start) * share)))


def mix(rows: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``rows`` of ``sized`` with their source's size and target, the words ``taken``, whole ``epochs``, words of the last, cut one
    (``part``), how many times the document starts (``copies``), and the words of the source before it in an epoch (``before``)."""
    targets = bounded(source_targets(rows, schedule, max_epochs)).withColumnRenamed("source", "_source")  # broadcast where it is small
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = running_totals(rows, ["source"], "key", {"before": F.col("size")}, ["size"])
    whole = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("epochs", epochs.cast("long"))
    left = whole - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("before")))
    rows = rows.withColumn("part", part.cast("long")).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return rows.withColumn("copies", F.col("epochs") + F.when(F.col("before") < left, 1).otherwise(0))


def ordered(mixed: DataFrame) -> DataFrame:
    """One row per copy that is taken, with its training ``position``, sorted by it over the whole table."""
    copies = mixed.filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = (F.col("epoch") * F.col("source_size") + F.col("before")) / F.col("target")
    copies = copies.withColumn("position", F.coalesce(position(share, F.col("w_start"), F.col("w_end")), F.lit(0.0)))
    return copies.orderBy("position", "key")


def trained_on(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: size, source's size and target, words ``taken`` by all its copies in the written, range-sorted table of
    copies, and the training positions of the first and the last of them (null without a copy)."""
    rows = written(sized(docs, F.monotonically_increasing_id().alias("_id")), "sized")
    mixed = written(mix(rows, schedule, max_epochs).drop("taken"), "mixed")
    words = F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.col("part"))
    copies = written(ordered(mixed).select("_id", "epoch", "position", words.alias("words")), "copies")
    of_document = copies.groupBy(F.col("_id").alias("_of")).agg(
        F.sum("words").alias("taken"), F.min("position").alias("first_position"), F.max("position").alias("last_position")
    )
    out = mixed.join(of_document, F.col("_id") == F.col("_of"), "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def mixed_documents(docs: DataFrame, schedule: Sequence[tuple[float, float]] = SCHEDULE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents the mix takes, whole, once per epoch that starts them, range-sorted by training position; columns as in ``docs``."""
    rows = sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return ordered(mix(rows, schedule, max_epochs)).select("_row.*")
