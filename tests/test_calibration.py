import random
import time

import pytest
from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens.functions import text as TX
from ticketlens.operators import calibration, training
from ticketlens.operators import metrics as M
from ticketlens.operators.features import build_features
from ticketlens.operators.prepare import drop_leaks
from ticketlens.sources import tables as T

SCHEMA = "split string, y int, p double"


def pooled(points):
    """Pool adjacent violators over (score, mean, weight): the fitted value of each score."""
    blocks = []
    for x, mean, weight in sorted(points):
        blocks.append([mean, weight, [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, xs = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[2] = (last[0] * last[1] + m * w) / (last[1] + w), last[1] + w, last[2] + xs
    return {x: m for m, _, xs in blocks for x in xs}


def scored_rows(n, seed=1):
    rnd = random.Random(seed)
    return [("validation", int(rnd.random() < p * p), p) for p in (rnd.randrange(200) / 200 for _ in range(n))]


def test_equals_pooling_one_by_one(spark):
    rows = scored_rows(3000)
    df = spark.createDataFrame([*rows, ("validation", 1, None)], SCHEMA).repartition(5)
    points = {}
    for _, y, p in rows:
        points.setdefault(p, []).append(y)
    want = pooled([(p, sum(v) / len(v), len(v)) for p, v in points.items()])
    out = calibration.calibrate(calibration.fit_calibration(df), df.withColumn("was", F.col("p")))
    assert out.columns == [*df.columns, "was"]
    got = {r.was: r.p for r in out.collect()}
    assert got.pop(None) is None and got == pytest.approx(want)
    ordered = [got[p] for p in sorted(got)]
    assert ordered == sorted(ordered) and len(set(ordered)) > 5


def test_order_is_kept(spark):
    """Scores in the order of the calibrated ones; only pairs that became equal change the AUC, to a half each."""
    df = spark.createDataFrame(scored_rows(2000), SCHEMA)
    out = calibration.calibrate(calibration.fit_calibration(df), df.withColumn("was", F.col("p"))).cache()
    assert out.groupBy("was").agg(F.count_distinct("p").alias("n")).filter("n <> 1").count() == 0
    rows = [(r.y, r.was, r.p) for r in out.collect()]
    good, bad = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    pairs = sum(0.5 if a[2] == b[2] else a[1] > b[1] for a in good for b in bad) / (len(good) * len(bad))
    assert M.roc_auc(out).first().auc_roc == pytest.approx(pairs)
    seen = spark.createDataFrame([("test", 0, -5.0), ("test", 0, 99.0)], SCHEMA)
    ends = [r.p for r in calibration.calibrate(calibration.fit_calibration(df), seen).collect()]
    values = [r[2] for r in rows]
    assert ends == [min(values), max(values)]
    with pytest.raises(ValueError):
        calibration.fit_calibration(df.limit(0))


def test_training_with_calibration(spark):
    split = drop_leaks(build_features(X.split_semantic(spark, "/root/testdata/sf0.001")))
    plain, done = (training.train(split, pipeline=training.logistic_baseline, calibrated=c) for c in (False, True))
    assert plain.calibration is None and done.calibration is not None
    means = done.scored.filter("split = 'validation'").agg(F.avg("p").alias("p"), F.avg("y").alias("y")).first()
    assert means.p == pytest.approx(means.y)  # what a calibrated probability adds up to


def test_split_names_stay_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "01"), (2, "02"), (3, "2024-01-01")], "id int, split string")
    path = T.write_splits(df, str(tmp_path / "s"))
    assert sorted(map(tuple, T.read_splits(spark, path).select("id", "split").collect())) == [(1, "01"), (2, "02"), (3, "2024-01-01")]
    assert [r.id for r in T.read_splits(spark, path, ["01"]).collect()] == [1]


def test_dashes_and_quotes_cost_little(spark):
    """Texts with characters above the Latin letters take about as long as texts without."""
    plain = "ação e reação do cliente " * 200
    odd = "ação — “reação” do cliente … ½ " * 170

    def seconds(text):
        df = spark.range(800).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).select(TX.normalize_text("t").alias("f"))
        times = []
        for _ in range(3):
            began = time.perf_counter()
            df.agg(F.sum(F.length("f"))).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    seconds(plain)
    assert seconds(odd) < 4 * seconds(plain)
    assert [r[0] for r in spark.createDataFrame([("a — “b” … \ue000½\ue0ff ﬁ",)], "t string").select(TX.normalize_text("t")).collect()] == ["A  B ... 12 FI"]
