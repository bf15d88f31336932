"""Work that is to grow no faster than its input: tasks for all cores, texts encoded once, tasks of bounded size."""

import math
import os
import random
from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params
from ticketlens.functions.text import has_token, normalize_text, tokens
from ticketlens.functions.vectors import all_distances, distance_to, nearest_centroid
from ticketlens.operators import clusters, encoders, profile, term_blocks
from ticketlens.operators import semantics as S
from ticketlens.operators import training
from ticketlens.runtime import evened, pinned
from ticketlens.streaming import scoring


def test_a_table_in_one_part_is_evened(spark):
    one = pinned(spark.range(1_000).coalesce(1))
    assert evened(one, 2_000) is one
    more = evened(one, 300)
    assert more.rdd.getNumPartitions() == 4 and sorted(r.id for r in more.collect()) == list(range(1_000))
    assert evened(one, 1).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    assert evened(pinned(spark.range(0).coalesce(1))).count() == 0


def test_training_uses_more_than_the_stored_part(spark, monkeypatch):
    seen = []

    def stops(matrix, *_):
        seen.append((matrix.rdd.getNumPartitions(), matrix.count()))
        raise InterruptedError

    monkeypatch.setattr(training, "fit_model", stops)
    rows = spark.range(120_000).coalesce(1).selectExpr("CAST(id % 2 AS INT) AS TARGET", "id AS x", "'train' AS split")
    with pytest.raises(InterruptedError):
        training.train(rows)
    assert seen == [(3, 120_000)]


class Counting:
    """Vectors of the length of a text; remembers how many texts it was given."""

    def __init__(self):
        self.given = []

    def encode(self, df, text):
        self.given.append(df.count())
        return df.withColumn("embedding", array_to_vector(F.array(F.length(text).cast("double"))))


def test_a_batch_encodes_each_text_once(spark, monkeypatch):
    encoder = Counting()
    level = S.LevelModel("TAB_N1", encoder, S.GivenCentroids(((1.0,), (9.0,))), ((0, "short"), (1, "long")), (1.0,), (2.0, 5.0))
    monkeypatch.setattr(scoring, "build_features", lambda df: df)
    monkeypatch.setattr(scoring, "feature_matrix", lambda df, label, carry: df)
    monkeypatch.setattr(scoring, "predict", lambda model, df, carry: df)
    texts = ["a", "abcdefgh", None]
    df = spark.createDataFrame([(i, texts[i % 3], 0) for i in range(90)], "k long, TAB_N1 string, TARGET int")
    out = scoring.score_tickets(df, S.SemanticModel({"TAB_N1": level}), None, "TARGET", ["k"])
    got = {(r.TAB_N1, r.TAB_N1_GROUP, r.TAB_N1_SENT_SCORE): r["count"] for r in out.groupBy("TAB_N1", "TAB_N1_GROUP", "TAB_N1_SENT_SCORE").count().collect()}
    assert got == {("a", "short", 1.0): 30, ("abcdefgh", "long", 8.0): 30, (None, "short", 3.0): 30}
    assert encoder.given == [3]


def test_distances_in_batches_are_the_direct_ones(spark):
    rnd = random.Random(3)
    points = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    points.append(points[1])
    sparse = [Vectors.sparse(5, sorted(rnd.sample(range(5), n)), [rnd.gauss(0, 1) for _ in range(n)]) for n in (0, 1, 3, 5, 0, 2)]
    data = [(i, v) for i, v in enumerate([*sparse, Vectors.dense([1.0, 0.0, -2.0, 0.0, 3.0]), None, Vectors.dense(points[1])])]
    df = spark.createDataFrame(data, ["i", "embedding"])
    for vector in (True, False):
        rows = df if vector else df.withColumn("embedding", F.when(F.col("embedding").isNotNull(), vector_to_array("embedding")))
        both = rows.select(
            "i", all_distances("embedding", points, vector).alias("got"),
            F.array(*[distance_to("embedding", p, vector) for p in points]).alias("want"),
            nearest_centroid("embedding", list(enumerate(points)), vector)["cluster_id"].alias("id"),
        ).collect()
        assert len(both) == len(data)
        assert all(r.got is None if data[r.i][1] is None else r.got == pytest.approx(r.want, abs=1e-12) for r in both)
        known = rows.filter("embedding IS NOT NULL")
        ids = {r.i: r.cluster_id for r in S.GivenCentroids(tuple(map(tuple, points))).transform(known).collect()}
        assert ids == {r.i: r.id for r in both if r.i in ids} and ids[8] == 1


def test_a_level_is_not_worked_out_for_the_next(spark):
    """Counting the texts of the second level reads no centroid of the first."""
    table = encoders.TableEncoder(spark.createDataFrame([("a", [1.0]), ("b", [9.0])], "text string, embedding array<float>"))
    level = S.LevelModel("A", table, S.GivenCentroids(((1.0,), (9.0,))), ((0, "first"),), None)
    df = spark.createDataFrame([("a", "b", 1), ("x", "a", 2), (None, None, 3)], "A string, B string, k int")
    first = S.SemanticModel({"A": level}).transform_rows(df)
    plan = first.groupBy("B").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "batch(" not in plan and "cluster_id" not in plan
    got = {r.k: (r.A_GROUP, r.B_GROUP) for r in S.SemanticModel({"A": level, "B": replace(level, tab="B")}).transform_rows(df).collect()}
    assert got == {1: ("first", "cluster_1"), 2: (None, "first"), 3: (None, None)}


def old_terms(text):
    words = F.filter(F.split(F.lower(normalize_text(text)), "[^a-z0-9]+"), lambda w: w != "")
    triples = F.flatten(
        F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3))))
    )
    return F.concat(words, F.transform(triples, lambda t: F.concat(F.lit("#"), t)))


def test_terms_by_pattern_are_those_of_the_words(spark):
    given = ["", " ", "a", "ab", "abc", "abcd é x9", "Não navega, não--NAVEGA 12 a.b", "ß½ ab_cd\nzz", None, "0123456789"]
    docs = X.documents(spark, "/root/testdata/sf0.001").select("text")
    df = docs.unionByName(spark.createDataFrame([(t,) for t in given], "text string"))
    assert df.filter(~encoders.word_and_trigram_terms("text").eqNullSafe(old_terms("text"))).count() == 0


def test_texts_are_read_once_for_fit_and_encoding(spark):
    df = pinned(X.documents(spark, "/root/testdata/sf0.001").select("text").distinct())
    encoder, encoded = encoders.fit_encode_hashed_tfidf(df)
    assert "regexp" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    want = {r.text: r.embedding for r in encoders.fit_hashed_tfidf(df).encode(df, "text").collect()}
    assert {r.text: r.embedding for r in encoded.collect()} == want == {r.text: r.embedding for r in encoder.encode(df, "text").collect()}


def test_exact_counts_are_dealt_into_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(profile, "TASK_CELLS", 100)
    df = pinned(spark.range(1_000).coalesce(1).selectExpr("id % 7 AS ID_CLIENTE", "id AS a", "IF(id % 2 = 0, id % 10, NULL) AS b"))
    seen, dealt = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *by: seen.append(n) or dealt(self, n, *by))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {r.feature: (r["values"], r.pairs) for r in profile.identifier_counts(df, ["a", "b"]).collect()}
    assert got == {"a": (1000, 1000), "b": (5, 35)} and seen == [20]
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_run_deals_tickets_of_one_part_first(spark, monkeypatch):
    """What the run prepares lies in more tasks than the one part that the tickets are stored in; a table with a task per core stays."""
    from ticketlens.plans import end_to_end
    from ticketlens.runtime import dealt

    seen = []

    def stops(tickets, *_):
        seen.append((tickets.rdd.getNumPartitions(), tickets.count()))
        raise InterruptedError

    monkeypatch.setattr(end_to_end, "prepare", stops)
    rows = spark.range(120_000).coalesce(1)
    with pytest.raises(InterruptedError):
        end_to_end.run(rows)
    assert seen[0][0] > 1 and seen[0][1] == 120_000
    each = spark.range(120_000).repartition(spark.sparkContext.defaultParallelism)
    assert dealt(each, 10) is each and evened(each, 10) is each


def test_words_of_a_block_are_the_tokens(spark):
    """And whether a text has one is told alike, however late it comes and wherever the first characters end."""
    given = ["", "a", "ab", "para que", "Para QUE x é", "ΑΣ ΑΣΑ İstanbul 𝔘𝔫 字字 _9 ²³", None, "de " * 80 + "fim", "a\nbc\0de", "x" * 300]
    given += [" " * n + word + tail for n in range(190, 202) for word in ("com", "comum", "ab") for tail in ("", " ", "o", "--")]
    docs = X.documents(spark, "/root/testdata/sf0.001").select("text")
    df = docs.unionByName(spark.createDataFrame([(t,) for t in given], "text string")).select("text", tokens("text").alias("w"), has_token("text").alias("any"))
    rows = df.collect()
    found = term_blocks.words_of(pa.array([r.text for r in rows])).to_pylist()
    stop = set(params.STOPWORDS)
    assert [[w for w in words if w not in stop] for words in found] == [r.w or [] for r in rows]
    assert all(r.any == (None if r.text is None else bool(r.w)) for r in rows)


def brute_scores(rows):
    """Mean TF-IDF by definition; rows of (group, words, n)."""
    out = {}
    for group in {g for g, _, _ in rows}:
        texts = [(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]), n) for g, w, n in rows if g == group]
        total, df = sum(n for _, n in texts), Counter()
        for counts, n in texts:
            df.update({t: n for t in counts})
        weights = [({t: c * (math.log((1 + total) / (1 + df[t])) + 1) for t, c in counts.items()}, n) for counts, n in texts]
        for w, n in weights:
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                out[group, t] = out.get((group, t), 0) + n * x / norm / total
    return out


def test_term_scores_of_many_small_blocks(spark, monkeypatch):
    """Blocks of some words, several buckets and slices: terms that blocks share come out once, with the scores of the definition."""
    monkeypatch.setattr(clusters, "SLICE_BYTES", 500)
    rnd = random.Random(5)
    words = ["sinal", "cabo", "rede", "fatura", "são", "字字", "visita", "fibra", "x1"]
    rows = [(("a", "b", None)[i % 3], i, " ".join(rnd.choices(words, k=rnd.randint(0, 9)) + ([f"só{i}"] if i % 4 == 0 else [])), rnd.randint(1, 3)) for i in range(240)]
    texts = spark.createDataFrame(rows, "g string, key int, text string, n int").repartition(5)
    cut, sent = term_blocks.cut_blocks, clusters.written

    def small(batches):
        cut.__globals__.update(BLOCK_WORDS=60, BLOCK_TEXTS=7)
        yield from cut(batches)

    counts = {}

    def counted(df, name="table", *rest):
        out = sent(df, name, *rest)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(term_blocks, "cut_blocks", small)
    monkeypatch.setattr(term_blocks, "BUCKET_TERMS", 300)
    monkeypatch.setattr(clusters, "written", counted)
    got = {(r.g, r.term): r.score for r in clusters.term_scores(texts, ["g"], "key").collect()}
    want = brute_scores([(g, t.split(), n) for g, _, t, n in rows])
    assert counts["blocks"][0] > 30 and sum(counts["scores"]) > counts["blocks"][0]
    assert got.keys() == want.keys() and all(got[k] is None if k[0] is None else got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    best = clusters.term_scores(texts, ["g"], "key", best=3)
    some = {(r.g, r.term): r.score for r in best.collect()}
    assert some.items() <= got.items() and len(some) < len(got)
    assert sorted(clusters.top_terms(best, ["g"], 3).collect()) == sorted(clusters.top_terms(clusters.term_scores(texts, ["g"], "key"), ["g"], 3).collect())


def test_terms_are_not_sent_as_text(spark):
    """Keyword weights move hashes and numbers between tasks: no exchange of the plan holds the terms or the texts."""
    texts = spark.range(40).selectExpr("CAST(id % 2 AS int) AS g", "id AS key", "concat('sinal rede', id) AS text", "1 AS n")
    plan = clusters.term_scores(texts, ["g"], "key")._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange" in line]
    assert keys and not any("term" in line or "text" in line for line in keys) and "Window" not in plan


def test_kmeans_leaves_no_vectors_on_disk(spark, monkeypatch):
    """k-means finds its rows kept in memory only, so that it keeps none on disk itself; they are let go at the end."""
    seen, fit = [], S.KMeans.fit

    def watched(self, rows):
        seen.append((rows.storageLevel.useMemory, rows.storageLevel.useDisk, rows.count()))
        return fit(self, rows)

    monkeypatch.setattr(S.KMeans, "fit", watched)
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    df = spark.createDataFrame([(Vectors.sparse(3, [i % 3], [1.0 + i % 2]), 1 + i % 2) for i in range(40)], ["embedding", "n"])
    model = S.fit_clusters(df, 3)
    assert seen == [(True, False, 40)] and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
    assert len(model.clusterCenters()) == 3
    alike = S.fit_clusters(spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1)] * 9, ["embedding", "n"]), 3)
    assert alike == S.GivenCentroids(((1.0, 2.0),)) and len(seen) == 1


def test_frequencies_are_stored_small(spark, monkeypatch):
    """What the encoder writes of whole documents takes less room than the documents."""
    paths, write = [], encoders.written

    def recorded(df, *rest):
        out = write(df, *rest)
        paths.extend(out.inputFiles())
        return out

    monkeypatch.setattr(encoders, "written", recorded)
    texts = X.documents(spark, "/root/testdata/sf0.01").select("text").filter("text IS NOT NULL").distinct()
    encoders.fit_encode_hashed_tfidf(texts)
    stored = sum(os.path.getsize(p.removeprefix("file:").replace("///", "/")) for p in paths)
    assert 0 < stored < 1.5 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")
