"""Quantile sketches per period, kept as a plain table, and drift between periods.

A sketch counts values in bins whose ends grow by a constant ratio, so every quantile is known within a relative error ``ERROR``. It
is a table (period, feature, bin, rows): two sketches merge by adding rows, in any order and exactly, so a stream that counts
as rows arrive holds what a batch over all of them counts. A period has as many rows as it has bins in use, however many values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.times import event_time, like

ERROR = 0.01
RATIO = (1 + ERROR) / (1 - ERROR)
#: Values nearer to 0 than this count as 0.
SMALLEST = 1e-9
#: A share of 0 counts as this much in the stability index.
LEAST_SHARE = 0.0001
_AT = "__at"


def bin_of(value: Column) -> Column:
    """0 for 0, else the signed number of the value's bin; null for null, NaN and infinite values."""
    size = F.abs(value.cast("double"))
    number = F.floor(F.log(size / SMALLEST) / math.log(RATIO)).cast("int") + 1
    signed = F.when(value < 0, -number).otherwise(number)
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (size < F.lit(float("inf")))
    return F.when(finite, F.when(size < SMALLEST, 0).otherwise(signed))


def bin_value(number: Column) -> Column:
    """The value that stands for a bin: within ``ERROR`` of all values in it."""
    size = SMALLEST * F.pow(F.lit(RATIO), F.abs(number) - 1) * (2 * RATIO / (1 + RATIO))
    return F.when(number == 0, 0.0).otherwise(F.signum(number) * size)


def _counted(df: DataFrame, features: Sequence[str], time: str, every: str) -> DataFrame:
    """Bins of each period of ``_AT``; the window, not its start, is the key, so that a watermark can close it."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(F.col(f)).alias("bin")) for f in features])
    rows = df.select(time, F.window(_AT, every).alias("window"), F.inline(cells))
    counted = rows.groupBy("window", "feature", "bin").agg(F.count("*").alias("rows"))
    return counted.select(like(df, time, F.col("window.start")).alias("period"), "feature", "bin", "rows")


def sketch(df: DataFrame, features: Sequence[str], time: str, every: str = "1 day") -> DataFrame:
    """(period, feature, bin, rows) of all features in one pass; ``bin`` is null for missing values, rows without a time are left out."""
    timed = df.filter(F.col(time).isNotNull())
    return _counted(timed.withColumn(_AT, event_time(df, time)), features, time, every)


def sketch_stream(stream: DataFrame, features: Sequence[str], time: str, every: str = "1 day", delay: str = "1 day") -> DataFrame:
    """The same over a stream, for append mode. A period is given out once, when the latest time seen is ``delay`` past its end.

    A row that comes after its period was given out is left out: the table is never changed afterwards. Without such rows the table
    equals ``sketch`` over the periods given out.
    """
    timed = stream.withColumn(_AT, event_time(stream, time)).withWatermark(_AT, delay)
    return _counted(timed, features, time, every)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches added up over everything but ``by``, feature and bin."""
    return sketches.groupBy(*by, "feature", "bin").agg(F.sum("rows").alias("rows"))


def quantiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str] = ("period",)) -> DataFrame:
    """(by, feature, share, value): the value at rank ceil(share * rows), from 1, within ``ERROR`` of the exact one. Missing values do not count."""
    by = list(by)
    group = Window.partitionBy(*by, "feature")  # over the bins in use
    counted = merged(sketches.filter(F.col("bin").isNotNull()), by)
    counted = counted.withColumn("upto", F.sum("rows").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = counted.withColumn("total", F.sum("rows").over(group))
    wanted = counted.withColumn("share", F.explode(F.lit([float(s) for s in shares])))
    rank = F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1))
    holds = (F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank)
    return wanted.filter(holds).select(*by, "feature", "share", bin_value(F.col("bin")).alias("value"))


def drift_of_periods(sketches: DataFrame, base: DataFrame, groups: int = 10, by: Sequence[str] = ("period",)) -> DataFrame:
    """Population stability index of each period and feature against a base sketch, and the share of missing values.

    Groups end at the base's quantiles (equal ends fall together), in whole bins, so both sides are cut at the same values. A feature without
    values in the base has no index.
    """
    by = list(by)
    ends = quantile_bins(base, groups)
    base_shares = _group_shares(merged(base), ends, []).select("feature", "group", F.col("share").alias("base_share"))
    own = _group_shares(merged(sketches, by), ends, by)
    both = own.join(base_shares, ["feature", "group"])
    gap = (F.col("share") - F.col("base_share")) * F.log(F.col("share") / F.col("base_share"))
    index = both.groupBy(*by, "feature").agg(F.sum(gap).alias("psi"))
    counted = merged(sketches, by).groupBy(*by, "feature").agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("rows"))), F.lit(0)).alias("missing")
    )
    return counted.join(index, [*by, "feature"], "left")


def quantile_bins(base: DataFrame, groups: int) -> DataFrame:
    """(feature, ends): the bins at which the base's ``groups`` equal shares end, ascending, without repeats; the last share is open."""
    group = Window.partitionBy("feature")
    counted = merged(base.filter(F.col("bin").isNotNull()))
    upto = F.sum("rows").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counted.withColumn("upto", upto).withColumn("total", F.sum("rows").over(group))
    cut = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max(groups - 1, 1)))))
    holds = (F.col("upto") * groups >= F.col("k") * F.col("total")) & ((F.col("upto") - F.col("rows")) * groups < F.col("k") * F.col("total"))
    return cut.filter(holds).groupBy("feature").agg(F.sort_array(F.collect_set("bin")).alias("ends"))  # at most groups - 1


def _group_shares(counted: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Share of each group of bins in each ``by``; groups without rows are there with the least share."""
    placed = counted.filter(F.col("bin").isNotNull()).join(ends, "feature")
    group = F.size(F.filter("ends", lambda end: end < F.col("bin")))
    found = placed.withColumn("group", group).groupBy(*by, "feature", "group").agg(F.sum("rows").alias("n"))
    wanted = placed.select(*by, "feature", F.explode(F.sequence(F.lit(0), F.size("ends"))).alias("group")).distinct()
    whole = Window.partitionBy(*by, "feature")
    full = wanted.join(found, [*by, "feature", "group"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.greatest(F.col("n").cast("double") / F.sum("n").over(whole), F.lit(LEAST_SHARE))
    return full.withColumn("share", share)
