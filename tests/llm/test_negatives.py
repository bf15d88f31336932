import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, count=3, low=50, high=95, scale=256):
    rows = {i: (label, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, label in rows}
    out = set()
    for a, (label, q) in rows.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, own == label) for i, (own, p) in rows.items() if i != a)
        near = [(i, -s) for s, i, same in scored if same][:positives]
        for p, ps in near:
            fit = [(i, -s) for s, i, same in scored if not same and low * ps <= -100 * s <= high * ps][:count]
            out |= {(a, p, rank, i, ps, ns) for rank, (i, ns) in enumerate(fit, 1)}
    return out


def mined(frame, every, **options):
    rows = negatives.mined(frame, F.col("id") % every == 0, **options).collect()
    out = {tuple(r) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(n, d, seed, labels=4, step=None):
    rnd = random.Random(seed)
    value = (lambda: rnd.choice(step)) if step else (lambda: rnd.gauss(0.1, 0.3))
    return [(i, [value() for _ in range(d)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rows = random_rows(400, 5, seed)
    assert mined(spark.createDataFrame(rows, SCHEMA), 7) == brute(rows, 7)


def test_many_ties(spark, monkeypatch):
    """Few different vectors and one label of most rows, in many small blocks."""
    monkeypatch.setattr(negatives, "LEAST_BLOCK_ROWS", 20)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 30)
    rows = random_rows(500, 3, 5, labels=2, step=(0.0, 0.25, 0.5))
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in rows]
    want = brute(rows, 10)
    assert want and mined(spark.createDataFrame(rows, SCHEMA).repartition(4), 10) == want
    assert mined(spark.createDataFrame(rows, SCHEMA), 10, positives=2, negatives=9, low=10, high=99) == brute(rows, 10, 2, 9, 10, 99)


def test_scores_beyond_doubles(spark):
    rnd = random.Random(3)
    rows = [(i, [float(np.float32(rnd.uniform(-2e5, 2e5))) for _ in range(4)], i % 3) for i in range(120)]
    assert max(r[5] for r in brute(rows, 4)) > 2**48
    assert mined(spark.createDataFrame(rows, SCHEMA), 4) == brute(rows, 4)


def test_odd_rows(spark):
    rows = random_rows(120, 4, 9)
    odd = [(200, None, 1), (201, [], 1), (202, [1.0, None, 1.0, 1.0], 1), (203, [math.nan] * 4, 1), (204, [math.inf] * 4, 1), (205, [1.0, 2.0], 1)]
    odd += [(206, [1.0] * 4, None), (None, [1.0] * 4, 1), (207, [3e38] * 4, 1)]
    frame = spark.createDataFrame(rows + rows[:30] + [(rows[0][0], rows[0][1], 99)] + odd, SCHEMA).withColumn("score", F.lit("x")).repartition(3)
    assert mined(frame, 5) == brute(rows, 5)  # a repeated id counts with its smallest label
    assert negatives.mined(spark.createDataFrame([], SCHEMA), F.col("id") % 5 == 0).count() == 0
    alone = [(i, [1.0, 1.0], i) for i in range(20)]  # no positives
    assert mined(spark.createDataFrame(alone, SCHEMA), 5) == set()
    with pytest.raises(ValueError):
        negatives.mined(frame, F.col("id") % 5 == 0, high=100)


def test_keys_keep_their_order():
    rnd = random.Random(1)
    keys = [(rnd.randint(-3, 3), rnd.randint(-(2**62), 2**62), rnd.randrange(2), rnd.randint(-(2**63), 2**63 - 1)) for _ in range(500)]
    assert [negatives.unpack(negatives.pack(*k)) for k in keys] == keys
    assert [negatives.unpack(k) for k in sorted(negatives.pack(*k) for k in keys)] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


def test_windows_stay_open_only_while_needed():
    """A stream far longer than memory of windows: the iterator holds an anchor's open windows only."""
    keys = [negatives.pack(1, 100, 0, 5), *(negatives.pack(1, 90, 1, i) for i in range(1000)), negatives.pack(1, 40, 0, 6), negatives.pack(1, 30, 1, 2000)]
    out = list(negatives.emitted(iter(keys), 3))
    assert out == [(1, 5, 1, 0, 100, 90), (1, 5, 2, 1, 100, 90), (1, 5, 3, 2, 100, 90), (1, 6, 1, 2000, 40, 30)]
    assert negatives.window(-10)[0] > negatives.window(-10)[1] and negatives.window(0) == (0, 0) and negatives.window(7) == (4, 6)
