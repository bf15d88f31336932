from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ticketlens.llm import mixing


def water_level(sizes, weights, epochs=3):
    """Targets by giving the excess to the others again and again."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left, w = total - sum(fixed.values()), sum(free.values())
        over = [s for s in free if left * free[s] / w > epochs * sizes[s]]
        if not over:
            return fixed | {s: left * free[s] / w for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


def check(docs):
    rows = mixing.mix(mixing.sized(docs)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = water_level(sizes, {s: float(i % 3 + 1) for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    return rows


def test_real(real_docs):
    assert len(check(real_docs)) == real_docs.count()


def test_odd_rows_and_reruns(odd_docs):
    assert len(check(odd_docs)) == odd_docs.count()
    a, b = (sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(mixing.sized(d)).collect()) for d in (odd_docs, odd_docs.repartition(5)))
    assert a == b


def test_capped_sources(spark):
    texts = [(i, "a " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (500, "c"), (40, "d"), (0, "e")])]
    check(spark.createDataFrame(texts, "doc_id long, text string, source string"))


def test_positions_follow_the_schedule(real_docs):
    out = mixing.ordered(mixing.mix(mixing.sized(real_docs)))
    rows = out.collect()
    assert all(0 <= r.position <= 1 for r in rows) and [r.position for r in rows] == sorted(r.position for r in rows)
    mean = {r.s: r.p for r in out.groupBy(F.when(F.col("w_end") > F.col("w_start"), "up").when(F.col("w_end") < F.col("w_start"), "down").otherwise("flat").alias("s")).agg(F.avg("position").alias("p")).collect()}
    assert mean["up"] > mean["flat"] > mean["down"]


def test_inverse(spark):
    shares = spark.range(0, 11).select((F.col("id") / 10).alias("y"))
    for start, end in mixing.SCHEDULE + ((0.0, 1.0), (1.0, 0.0)):
        for r in shares.withColumn("t", mixing.position(F.col("y"), F.lit(start), F.lit(end))).collect():
            assert start * r.t + (end - start) * r.t**2 / 2 == pytest.approx(r.y * (start + end) / 2, abs=1e-9)


def test_documents_keep_their_columns(odd_docs, no_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    plan = mixing.mix(mixing.sized(odd_docs)).collect()
    assert out.count() == sum(r.copies for r in plan)
    assert mixing.mixed_documents(no_docs).count() == 0 and mixing.mix(mixing.sized(no_docs)).count() == 0


def test_no_python_on_the_path(real_docs):
    plan = mixing.mixed_documents(real_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_documents_of_downsampled_sources(spark):
    """A document without words is taken where it lies before the cut, and only there."""
    rows = [(i, None if i % 2 else "a " * 10, "hot" if i < 400 else "small") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hot = [r for r in mixing.mix(mixing.sized(docs)).collect() if r.source == "hot"]
    cut = int(hot[0].target)
    assert 0 < cut < hot[0].source_size
    for r in hot:
        assert r.copies == (1 if r.before < cut else 0), r
    assert {r.copies for r in hot if r.size == 0} == {0, 1}


def test_query_follows_the_copies(real_docs, odd_docs):
    """One row per document, from the copies; another schedule with the same integrals moves the positions and nothing else."""
    for docs in (real_docs, odd_docs):
        rows = mixing.trained_on(docs).collect()
        copies, plan = mixing.ordered(mixing.mix(mixing.sized(docs))).collect(), mixing.mix(mixing.sized(docs)).collect()
        assert sorted((str(r.doc_id), r.size, r.taken) for r in rows) == sorted((str(r.doc_id), r.size, r.taken) for r in plan)
        for i in {r.doc_id for r in rows if r.doc_id is not None and r.doc_id != 3}:
            at = [c.position for c in copies if c.doc_id == i]
            (r,) = [r for r in rows if r.doc_id == i]
            assert (r.first_position, r.last_position) == ((min(at), max(at)) if at else (None, None))
    curved, flat = (
        {r.doc_id: r for r in mixing.trained_on(real_docs, schedule).collect()} for schedule in (mixing.SCHEDULE, ((1.0, 1.0), (2.0, 2.0), (3.0, 3.0)))
    )
    assert all(curved[i].taken == flat[i].taken for i in flat) and any(curved[i].first_position != flat[i].first_position for i in flat)
