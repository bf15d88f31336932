"""Streams: what they count and score is what a batch would; late rows, repeated tickets and restarts."""

import datetime
import math
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ticketlens.operators import sketches
from ticketlens.streaming import scoring

SCHEMA = "id long, at timestamp_ntz, x double"
DAY = datetime.datetime(2024, 1, 1)


def rows(n, seed=1, first_day=0, days=5):
    rnd = random.Random(seed)
    value = lambda: rnd.choice((None, math.nan, 0.0, rnd.gauss(0, 100), rnd.lognormvariate(0, 4), -1e-12, 5.0))
    return [(i, DAY + datetime.timedelta(days=first_day, seconds=rnd.randrange(days * 86400)), value()) for i in range(n)]


def test_quantiles_are_within_the_error(spark):
    data = rows(4000)
    table = sketches.sketch(spark.createDataFrame([*data, (9, None, 1.0)], SCHEMA), ["x"], "at").cache()
    assert table.agg(F.sum("rows")).first()[0] == 4000
    by_day = {}
    for _, at, x in data:
        if x is not None and not math.isnan(x):
            by_day.setdefault(at.date(), []).append(x)
    for by, groups in ((("period",), by_day), ((), {None: [x for v in by_day.values() for x in v]})):
        got = sketches.quantiles(table, [0.0, 0.1, 0.5, 0.99, 1.0], by).collect()
        assert len(got) == 5 * len(groups)
        for r in got:
            values = sorted(groups[r.period.date() if by else None])
            exact = values[max(math.ceil(r.share * len(values)), 1) - 1]
            assert abs(r.value - exact) <= 1.0001 * sketches.ERROR * abs(exact) + 2e-9
    missing = table.filter("bin IS NULL").agg(F.sum("rows")).first()[0]
    assert missing == sum(x is None or math.isnan(x) for _, _, x in data)


def test_merging_is_exact(spark):
    data = rows(900)
    parts = [sketches.sketch(spark.createDataFrame(data[i::3], SCHEMA), ["x"], "at") for i in range(3)]
    whole = sketches.sketch(spark.createDataFrame(data, SCHEMA), ["x"], "at")
    added = sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["period"])
    assert sorted(map(str, added.select("period", "bin", "rows").collect())) == sorted(map(str, whole.select("period", "bin", "rows").collect()))


def test_drift_finds_the_shift(spark):
    base = [(i, DAY, float(i % 100)) for i in range(1000)]
    data = base + [(i, DAY + datetime.timedelta(days=1), float(i % 100)) for i in range(500)] + [(i, DAY + datetime.timedelta(days=2), 200.0) for i in range(500)]
    data += [(1, DAY + datetime.timedelta(days=3), None)]
    table = sketches.sketch(spark.createDataFrame(data, SCHEMA), ["x"], "at").cache()
    got = {r.period.day: r for r in sketches.drift_of_periods(table, table.filter(F.col("period") == F.lit(DAY).cast("timestamp_ntz"))).collect()}
    assert got[1].psi == pytest.approx(0) and got[2].psi < 0.01 and got[3].psi > 2
    assert got[4].psi is None and got[4].missing == got[4].rows == 1


def landed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_and_leaves_late_rows_out(spark, tmp_path):
    """Files arrive in order; the last one brings rows of a day that was given out already."""
    folder = str(tmp_path / "in")
    early, middle, late = rows(300, 1, 0, 2), rows(300, 2, 4, 2), rows(50, 3, 0, 1)
    landed(spark, folder, [early, middle])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)

    def go_on():
        scoring.run_available(source, str(tmp_path / "out"), str(tmp_path / "state"), lambda df: sketches.sketch_stream(df, ["x"], "at"))
        return spark.read.parquet(str(tmp_path / "out"))

    def same(got, data, until):
        want = sketches.sketch(spark.createDataFrame(data, SCHEMA), ["x"], "at").filter(F.col("period") < F.lit(until).cast("timestamp_ntz"))
        assert got.schema["period"].dataType == want.schema["period"].dataType
        assert sorted(map(str, got.select("period", "feature", "bin", "rows").collect())) == sorted(map(str, want.collect()))

    same(go_on(), early, DAY + datetime.timedelta(days=2))
    last = [(999, DAY + datetime.timedelta(days=9), 1.0)]
    landed(spark, folder, [late + last])
    same(go_on(), early + middle, DAY + datetime.timedelta(days=8))  # the late rows are in no period


def test_restart_loses_and_doubles_nothing(spark, tmp_path):
    """A batch that was written and then failed is written again in its place; repeated tickets are scored once."""
    folder, output = str(tmp_path / "in"), str(tmp_path / "out")
    data = [(i, at, float(i)) for i, (_, at, _) in enumerate(rows(300))]
    landed(spark, folder, [data[:100], data[50:200], data[200:] + data[:20]])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    distinct = scoring.distinct_tickets(source, "id", "at", "30 days")
    assert distinct.columns == source.columns

    def once(broken):
        write = scoring.write_batches(output, lambda df: df.withColumn("twice", F.col("x") * 2))

        def run(batch, number):
            write(batch, number)
            if broken and number == 1:
                raise RuntimeError("stopped")

        query = distinct.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(StreamingQueryException):
        once(True)
    once(False)
    got = spark.read.parquet(output).collect()
    assert sorted((r.id, r.twice) for r in got) == [(i, 2.0 * i) for i in range(300)]


def test_scored_stream_files_come_from_several_tasks(spark, monkeypatch, tmp_path):
    """A large table's part of the stream is not one file of one task; a batch takes the files of a part."""
    from types import SimpleNamespace

    from ticketlens.catalog import models

    def stops(source, *_, **__):
        raise InterruptedError

    tickets = spark.range(120_000).coalesce(1).selectExpr("id AS PROTOCOLO")
    monkeypatch.setattr(models, "known_run", lambda *_: SimpleNamespace(semantics=None, training=SimpleNamespace(model=None)))
    monkeypatch.setattr(models, "known_tickets", lambda *_: tickets)
    monkeypatch.setattr(models, "scratch_path", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(models.scoring, "score_stream", stops)
    with pytest.raises(InterruptedError):
        models.scored_stream(spark, "")
    assert len(list((tmp_path / "raw").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 160_000
