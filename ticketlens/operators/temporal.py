"""Splits and evaluation along time: cuts at exact shares, rolling origins, metrics per period.

Rows are ordered by time and, at one time, by a hash of their key. The order statistics the cuts need are found without sorting: a
histogram over the range that must hold a cut is refined until the range has few rows, which are then ranked. Each refinement is one
aggregate for all cuts. A single time that holds very many rows is refined by the hash. Assigning the split is a comparison with
two values per cut, so no row is moved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.functions.times import micros
from ticketlens.operators import metrics as M
from ticketlens.operators.split import _share, check_shares, key_hash, row_text
from ticketlens.operators.training import boosted_trees, fit_model, predict
from ticketlens.runtime import checkpoint_base

BINS = 4_096
#: A range with at most so many rows is ranked on the driver.
FEW_ROWS = 10_000
_TIME, _DIGITS, _HASH = "__time", "__digits", "__hash"
_LAST_DIGITS = 16**15 - 1


def _ordered(df: DataFrame, time: str, key: str, seed: int) -> DataFrame:
    hashed = key_hash(key, seed, row_text(df))
    keyed = df.withColumn(_TIME, micros(df, time)).withColumn(_HASH, hashed)
    return keyed.withColumn(_DIGITS, F.conv(F.substring(_HASH, 1, 15), 16, 10).cast("long"))


class _Range:
    """The rows that hold the order statistic at ``position``: a range of times, or of hash digits at one time."""

    def __init__(self, position: int, low: int, high: int, rows: int):
        self.position, self.before, self.rows = position, 0, rows
        self.at_time: int | None = None
        self.low, self.high = low, high

    @property
    def width(self) -> int:
        return (self.high - self.low) // BINS + 1

    @property
    def settled(self) -> bool:
        return self.rows <= FEW_ROWS or (self.at_time is not None and self.low == self.high)

    def holds(self) -> Column:
        if self.at_time is None:
            return F.col(_TIME).between(F.lit(self.low), F.lit(self.high))
        return (F.col(_TIME) == F.lit(self.at_time)) & F.col(_DIGITS).between(F.lit(self.low), F.lit(self.high))

    def bin(self) -> Column:
        value = F.col(_TIME if self.at_time is None else _DIGITS)
        return F.when(self.holds(), F.floor((value - F.lit(self.low)) / F.lit(self.width)))

    def refine(self, counts: dict[int, int]) -> None:
        before = self.before
        for number in sorted(counts):
            if before + counts[number] > self.position:
                break
            before += counts[number]
        self.before, self.rows = before, counts[number]
        low = self.low + number * self.width
        self.low, self.high = low, min(self.high, low + self.width - 1)
        if self.at_time is None and self.low == self.high:
            self.at_time, self.low, self.high = self.low, 0, _LAST_DIGITS


def order_statistics(rows: DataFrame, positions: Sequence[int], total: int, low: int, high: int) -> list[tuple[int, str]]:
    """(time, hash) of the rows at the given positions (from 0) in the order of time and hash."""
    ranges = [_Range(p, low, high, total) for p in positions]
    while open_ := [(i, r) for i, r in enumerate(ranges) if not r.settled]:
        cells = F.array(*[F.struct(F.lit(i).alias("cut"), r.bin().alias("bin")) for i, r in open_])
        found = rows.select(F.inline(cells)).filter("bin IS NOT NULL").groupBy("cut", "bin").agg(F.count("*").alias("rows")).collect()
        for i, r in open_:
            r.refine({f.bin: f.rows for f in found if f.cut == i})
    out = []
    for r in ranges:
        inside = rows.filter(r.holds())
        if r.rows > FEW_ROWS:  # copies of one key at one time, which no order tells apart
            out.append((r.at_time, inside.agg(F.min(_HASH)).first()[0]))
        else:
            out.append(tuple(sorted(map(tuple, inside.select(_TIME, _HASH).collect()))[r.position - r.before]))
    return out


def temporal_share_split(
    df: DataFrame,
    time: str,
    key: str = params.TICKET,
    seed: int = params.SEED,
    shares: tuple[float, float, float] = params.SPLIT_SHARES,
) -> DataFrame:
    """Add ``split`` by time: the first rows train, the last test, each in its share exact to the row.

    Rows of the time at a cut are told apart by a hash of ``key`` (copies of a key at one time stay together; rows without a key are told
    apart by all their columns). Rows without a time have no split.
    """
    check_shares(*shares)
    rows = _ordered(df, time, key, seed).filter(F.col(_TIME).isNotNull()).select(_TIME, _DIGITS, _HASH)
    total, low, high = rows.agg(F.count("*"), F.min(_TIME), F.max(_TIME)).first()
    last = _share(shares[2])
    places = [int(total * (1 - _share(shares[1]) - last)), int(total * (1 - last))]
    inside = [p for p in places if p < total]
    cuts = order_statistics(rows, inside, total, low, high) if inside else []
    keyed, split = _ordered(df, time, key, seed), F.lit("test") if len(cuts) == 2 else F.lit("validation" if cuts else "train")
    for name, (at, digits) in list(zip(("train", "validation"), cuts))[::-1]:
        before = (F.col(_TIME) < F.lit(at)) | ((F.col(_TIME) == F.lit(at)) & (F.col(_HASH) < F.lit(digits)))
        split = F.when(before, name).otherwise(split)
    split = F.when(F.col(_TIME).isNotNull(), split)
    return keyed.select(*[F.col(f"`{c}`") for c in df.columns], split.alias("split"))


def with_period(df: DataFrame, time: str, every: str = "month") -> DataFrame:
    """Add ``period``: the date on which the row's day, week, month, quarter or year begins; null without a time."""
    return df.withColumn("period", F.date_trunc(every, F.col(time)).cast("date"))


def metrics_per_period(scored: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives, exact AUC, precision, recall and F1 of each period, and how far AUC and F1 are below the first period's.

    ``scored`` has ``period``, ``y`` and ``p``; rows without a period are left out. ``by`` keeps groups apart, for example origins.
    """
    by = list(by)
    table = M.evaluate(scored.filter(F.col("period").isNotNull()), threshold, [*by, "period"])
    first = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    positives = F.col("tp") + F.col("fn")
    return table.select(
        *by,
        "period",
        (positives + F.col("fp") + F.col("tn")).alias("rows"),
        positives.alias("positives"),
        "auc_roc",
        "precision",
        "recall",
        "f1_score",
        (F.first("auc_roc", ignorenulls=True).over(first) - F.col("auc_roc")).alias("auc_decay"),
        (F.first("f1_score").over(first) - F.col("f1_score")).alias("f1_decay"),
    )


def rolling_origin(
    matrix: DataFrame, inputs: Sequence[str], horizon: int = 1, pipeline=boosted_trees, parallelism: int = 1, **settings
) -> DataFrame:
    """(origin, ahead, period, y, p): for each period but the first, a model of all earlier rows scores the ``horizon`` periods from it on.

    ``ahead`` is 1 for the first period scored. One model per period; an origin whose earlier rows have one class is left out.
    """
    checkpoint_base(matrix.sparkSession)
    counted = matrix.filter(F.col("period").isNotNull()).groupBy("period").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    periods = counted.orderBy("period").collect()  # a row per period
    origins = [i for i in range(1, len(periods)) if min(p.low for p in periods[:i]) < max(p.high for p in periods[:i])]

    def scored(i: int) -> DataFrame:
        at, ahead = periods[i].period, [p.period for p in periods[i : i + horizon]]
        model = fit_model(matrix.filter(F.col("period") < F.lit(at)), pipeline(inputs, **settings))
        rows = predict(model, matrix.filter(F.col("period").between(F.lit(at), F.lit(ahead[-1]))), ["period"])
        number = reduce(lambda n, p: F.when(F.col("period") == F.lit(p[1]), p[0] + 1).otherwise(n), enumerate(ahead), F.lit(None))
        return rows.select(F.lit(at).alias("origin"), number.cast("int").alias("ahead"), "period", "y", "p")

    if not origins:
        return matrix.sparkSession.createDataFrame([], "origin date, ahead int, period date, y int, p double")
    with ThreadPool(min(parallelism, len(origins))) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(matrix.sparkSession)(scored), origins))
