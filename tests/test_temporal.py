import datetime
import random

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import temporal, training
from ticketlens.operators.split import key_hash

SCHEMA = "PROTOCOLO long, AT timestamp_ntz, TARGET int"
START = datetime.datetime(2024, 3, 30, 22)


def tickets(spark, n=3000, seed=1):
    """Many rows at one time, some without a time, times on both sides of a change of clocks."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = START if i % 3 == 0 else START + datetime.timedelta(microseconds=rnd.randrange(10**11))
        rows.append((i, None if i % 50 == 7 else at, i % 2))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def expected(df, shares):
    hashed = df.filter("AT IS NOT NULL").select("PROTOCOLO", "AT", key_hash("PROTOCOLO", 42).alias("h")).collect()
    order = [r.PROTOCOLO for r in sorted(hashed, key=lambda r: (r.AT, r.h))]
    a, b = round(len(order) * shares[0] - 0.4999), round(len(order) * (shares[0] + shares[1]) - 0.4999)
    return {i: "train" if k < a else "validation" if k < b else "test" for k, i in enumerate(order)}


@pytest.mark.parametrize("few, bins", [(10_000, 4096), (5, 16), (1, 2)])
def test_shares_are_exact(spark, monkeypatch, few, bins):
    monkeypatch.setattr(temporal, "FEW_ROWS", few)
    monkeypatch.setattr(temporal, "BINS", bins)
    df = tickets(spark, 600 if bins == 2 else 3000)
    for shares in ((0.8, 0.1, 0.1), (0.2, 0.2, 0.6)) if bins > 2 else ((0.3, 0.3, 0.4),):
        placed = temporal.temporal_share_split(df, "AT", shares=shares)
        assert placed.columns == [*df.columns, "split"]
        got = {r.PROTOCOLO: r.split for r in placed.collect()}
        want = expected(df, shares)
        assert {k: v for k, v in got.items() if v is not None} == want and sum(v is None for v in got.values()) == len(got) - len(want)


def test_odd_tables(spark, monkeypatch):
    df = tickets(spark)
    assert temporal.temporal_share_split(df.limit(0), "AT").count() == 0
    assert {r.split for r in temporal.temporal_share_split(df.filter("AT IS NULL"), "AT").collect()} == {None}
    every = temporal.temporal_share_split(df, "AT", shares=(1.0, 0.0, 0.0)).filter("AT IS NOT NULL")
    assert {r.split for r in every.collect()} == {"train"}
    monkeypatch.setattr(temporal, "FEW_ROWS", 10)
    copies = spark.createDataFrame([(1, START, 0)] * 100, SCHEMA)  # one key at one time: not told apart
    assert len({r.split for r in temporal.temporal_share_split(copies, "AT").collect()}) == 1
    one = temporal.temporal_share_split(copies.limit(1), "AT")
    assert [r.split for r in one.collect()] == ["test"]


def test_kinds_of_time(spark):
    df = tickets(spark)
    want = df.select((F.date_diff(F.col("AT").cast("date"), F.lit("1970-01-01")) * 86400 + F.hour("AT") * 3600 + F.minute("AT") * 60 + F.second("AT")).alias("s"))
    got = df.select(temporal.micros(df, "AT").alias("t"))
    assert sorted(r.t // 10**6 for r in got.collect() if r.t is not None) == sorted(r.s for r in want.collect() if r.s is not None)
    zoned = df.select(F.col("AT").cast("timestamp").alias("AT"))
    assert zoned.select(temporal.micros(zoned, "AT").alias("t")).exceptAll(got).count() == 0  # the session is in UTC
    days = df.select(F.col("AT").cast("date").alias("AT"))
    assert days.select(temporal.micros(days, "AT").alias("t")).filter("t % 86400000000 <> 0").count() == 0


def test_rolling_origin_trains_on_the_past_only(spark):
    """A label that turns over with the second period: models of the past fail on it until they have seen it."""
    rows = [(datetime.date(2024, 1 + m, 1), int((x > 50) != (m >= 1)), float(x)) for m in range(4) for x in range(100)] + [(None, 0, 1.0)]
    matrix = spark.createDataFrame(rows, "period date, label int, x double")
    scored = temporal.rolling_origin(matrix, ["x"], 2, training.logistic_baseline, parallelism=2).cache()
    table = {(r.origin.month, r.ahead): r for r in temporal.metrics_per_period(scored, 0.5, ["origin"]).join(scored.select("origin", "period", "ahead").distinct(), ["origin", "period"]).collect()}
    assert set(table) == {(2, 1), (2, 2), (3, 1), (3, 2), (4, 1)}
    assert table[2, 1].auc_roc == 0.0 and table[4, 1].auc_roc == 1.0 and all(r.rows == 100 for r in table.values())
    assert table[2, 1].auc_decay == 0.0
    none = temporal.rolling_origin(matrix.filter("period IS NULL"), ["x"], 1, training.logistic_baseline)
    assert none.columns == ["origin", "ahead", "period", "y", "p"] and none.count() == 0
