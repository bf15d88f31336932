"""Queries: learned operators. Where a result is learned, the query checks a property that has an exact value."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params
from ticketlens.catalog.oracle_parts import INPUTS
from ticketlens.catalog.registry import query
from ticketlens.catalog.tables import rounded
from ticketlens.functions.vectors import all_distances, is_vector, squared_norm
from ticketlens.operators import encoders, temporal, training
from ticketlens.operators import metrics as M
from ticketlens.operators import semantics as S
from ticketlens.operators.features import build_features
from ticketlens.operators.prepare import drop_leaks, prepare
from ticketlens.operators.folds import fold_balance, stratified_customer_folds
from ticketlens.operators.split import stratified_split
from ticketlens.operators.temporal import with_period
from ticketlens.operators.training import feature_matrix, input_names
from ticketlens.plans.end_to_end import Run, run
from ticketlens.runtime import dealt, evened, pinned, scratch_path, written
from ticketlens.sources import published
from ticketlens.sources.tables import read_table, write_importances
from ticketlens.streaming import scoring

_RUNS: dict[tuple[str, str], Run] = {}


def trained(spark, sf_dir) -> Run:
    """One full run per session and table folder; its parts serve several queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = run(X.tickets(spark, sf_dir))
    return _RUNS[key]


def _split_tickets(spark, sf_dir):
    """Raw tickets with their split."""
    return prepare(X.tickets(spark, sf_dir), keep=["PROTOCOLO"])


_ENRICHED: dict[tuple[str, str], tuple[S.SemanticModel, DataFrame]] = {}


def enriched_tickets(spark, sf_dir) -> tuple[S.SemanticModel, DataFrame]:
    """Semantic model and enriched table, fitted once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENRICHED:
        _ENRICHED[key] = S.enrich(_split_tickets(spark, sf_dir), salt_by=["PROTOCOLO"])
    return _ENRICHED[key]


_SPLIT_TEXTS = f"""{X.oracle_views('split_semantic')}, texts AS (
{' UNION ALL '.join(f"SELECT 'TAB_N{i}' AS tab, split, coalesce(TAB_N{i}, 'nan') AS text FROM tickets JOIN split_semantic USING (PROTOCOLO)" for i in (1, 2, 3))})"""


def _unit_norms(encoder, dictionary):
    encoded = encoder.encode(dictionary, "text")
    square = squared_norm("embedding", is_vector(encoded, "embedding"))
    return encoded.groupBy("tab").agg(
        F.count("*").alias("texts"), F.count_if(F.abs(square - 1) < 1e-5).alias("unit_vectors")
    )


_TEXTS_PER_TAB = f"{_SPLIT_TEXTS} SELECT tab, count(DISTINCT text) AS texts, count(DISTINCT text) AS"


@query("M2_hashed_encoder", f"{_TEXTS_PER_TAB} unit_vectors FROM texts GROUP BY tab")
def hashed_encoder(spark, sf_dir):
    dictionary = pinned(S.text_dictionary(X.tickets(spark, sf_dir), list(params.CLUSTERS_PER_TAB)))
    return _unit_norms(encoders.fit_hashed_tfidf(dictionary), dictionary)


@query("M2_word2vec_encoder", f"{_TEXTS_PER_TAB} unit_vectors FROM texts GROUP BY tab")
def word2vec_encoder(spark, sf_dir):
    dictionary = pinned(S.text_dictionary(X.tickets(spark, sf_dir), list(params.CLUSTERS_PER_TAB)))
    return _unit_norms(encoders.fit_word2vec(dictionary), dictionary)


def letter_counts():
    """A stand-in for a local model: counts of 26 letters, at unit length."""
    import numpy as np

    def encode(texts):
        rows = [[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts]
        matrix = np.array(rows, dtype="float32")
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)

    return encode


@query("M2_batch_encoder", f"{_TEXTS_PER_TAB} unit_vectors FROM texts GROUP BY tab")
def batch_encoder(spark, sf_dir):
    dictionary = pinned(S.text_dictionary(X.tickets(spark, sf_dir), list(params.CLUSTERS_PER_TAB)))
    return _unit_norms(encoders.BatchEncoder(letter_counts, 64), dictionary)


def _at_nearest(encoded, k):
    """Texts, and how many belong to the centroid that is nearest by direct comparison."""
    vector = is_vector(encoded, "embedding")
    model = S.fit_clusters(encoded, k)
    checked = model.transform(encoded).withColumn("distances", all_distances("embedding", model.clusterCenters(), vector))
    own = F.element_at("distances", F.col("cluster_id") + 1)
    return checked.agg(F.count("*").alias("texts"), F.count_if(own <= F.array_min("distances") + 1e-9).alias("at_nearest"))


@query("M3_kmeans_fit", f"{_TEXTS_PER_TAB} at_nearest FROM texts GROUP BY tab")
def kmeans_fit(spark, sf_dir):
    """Each text level with its own number of clusters."""
    dictionary = pinned(S.text_dictionary(X.tickets(spark, sf_dir), list(params.CLUSTERS_PER_TAB)))
    parts = []
    for tab, clusters in params.CLUSTERS_PER_TAB.items():
        own = dictionary.filter(F.col("tab") == tab)
        texts, rows = own.agg(F.count("*"), F.sum("n")).first()
        encoded = pinned(encoders.fit_hashed_tfidf(own).encode(own, "text"))
        parts.append(_at_nearest(encoded, S.cluster_count(clusters, rows, texts)).withColumn("tab", F.lit(tab)))
    return reduce(DataFrame.unionByName, parts)


@query(
    "M3_kmeans_of_documents",
    "SELECT count(DISTINCT trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS texts, count(DISTINCT trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS at_nearest FROM documents",
)
def kmeans_of_documents(spark, sf_dir):
    """The same with very many more texts than clusters: whole documents, 18 clusters, the default encoder."""
    dictionary = written(S.text_dictionary(X.documents(spark, sf_dir).select("text"), ["text"]), "dictionary", "zstd")
    _, encoded = encoders.fit_encode_hashed_tfidf(dictionary)
    return _at_nearest(encoded.drop("text"), 18)


@query(
    "M7_semantic_fit",
    f"""{_SPLIT_TEXTS}, d AS (SELECT tab, count(*) AS fitted_rows, count(DISTINCT text) AS texts FROM texts WHERE split = 'train' GROUP BY tab)
SELECT tab, fitted_rows, texts, greatest(2, least(CASE tab WHEN 'TAB_N1' THEN 6 WHEN 'TAB_N2' THEN 12 ELSE 18 END, texts)) AS clusters FROM d""",
)
def semantic_fit(spark, sf_dir):
    """One model per text column, on the train split."""
    df = _split_tickets(spark, sf_dir)
    dictionary = pinned(S.text_dictionary(df, list(params.CLUSTERS_PER_TAB)))
    model = S.fit_semantics(df, dictionary=dictionary)
    ks = {tab: level.kmeans.getOrDefault("k") for tab, level in model.levels.items()}
    k = F.create_map(*[part for tab, value in ks.items() for part in (F.lit(tab), F.lit(value).cast("long"))])
    return (
        dictionary.filter(F.col("n_fit") > 0)
        .groupBy("tab")
        .agg(F.sum("n_fit").alias("fitted_rows"), F.count("*").alias("texts"))
        .withColumn("clusters", F.element_at(k, F.col("tab")))
    )


@query("M9_fit_transform", f"{_SPLIT_TEXTS} SELECT tab, count(DISTINCT text) AS texts, count(DISTINCT text) AS text_group_pairs FROM texts GROUP BY tab")
def fit_transform(spark, sf_dir):
    """A text has one group, wherever it stands."""
    df = X.tickets(spark, sf_dir)
    _, enriched = S.enrich(df, salt_by=["PROTOCOLO"])
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("tab"), F.coalesce(t, F.lit("nan")).alias("text"), F.col(f"{t}_GROUP").alias("semantic_group"))
            for t in params.CLUSTERS_PER_TAB
        ]
    )
    pairs = enriched.select(F.inline(cells)).distinct()
    return pairs.groupBy("tab").agg(
        F.count_distinct("text").alias("texts"), F.count("semantic_group").alias("text_group_pairs")
    )


@query(
    "M10_enrich_all_splits",
    f"{_SPLIT_TEXTS} SELECT tab, split, count(*) AS rows, count(*) AS enriched FROM texts GROUP BY tab, split",
)
def enrich_all_splits(spark, sf_dir):
    _, enriched = enriched_tickets(spark, sf_dir)
    cells = F.array(
        *[
            F.struct(
                F.lit(t).alias("tab"),
                (
                    F.col(f"{t}_GROUP").isNotNull()
                    & F.col(f"{t}_SENT_SCORE").isNotNull()
                    & F.col(f"{t}_SENT_LABEL").isin(params.NEGATIVE, params.NEUTRAL, params.POSITIVE)
                ).alias("ok"),
            )
            for t in params.CLUSTERS_PER_TAB
        ]
    )
    long = enriched.select("split", F.inline(cells))
    return long.groupBy("tab", "split").agg(F.count("*").alias("rows"), F.count_if("ok").alias("enriched"))


@query(
    "M10_growing_dictionary",
    f"""{X.oracle_views('tickets')}, cells AS (
{' UNION ALL '.join(f"SELECT 'TAB_N{i}' AS tab, CANAL <> 'error' AS old, coalesce(TAB_N{i}, 'nan') AS text FROM tickets" for i in (1, 2, 3))}),
texts AS (SELECT tab, text, coalesce(bool_or(old), false) AS old FROM cells GROUP BY tab, text),
counts AS (SELECT tab, count(*) FILTER (WHERE old) AS first_texts, count(*) FILTER (WHERE NOT old) AS second_texts FROM texts GROUP BY tab)
SELECT tab, first_texts, second_texts, 0 AS third_texts, (SELECT count(*) FROM tickets) AS equal_rows FROM counts""",
)
def growing_dictionary(spark, sf_dir):
    """Texts scored in runs over tickets of all channels but one, over all tickets, and over all again; rows equal to a run without a store."""
    df = X.tickets(spark, sf_dir)
    model = S.fit_semantics(df)
    path = scratch_path(spark, "scored_texts")
    runs = [S.enrich_growing(model, part, path, ["PROTOCOLO"]) for part in (df.filter("CANAL <> 'error'"), df, df)]
    tabs = list(params.CLUSTERS_PER_TAB)
    scored = reduce(DataFrame.unionByName, [r.new_texts.select("tab", F.lit(i).alias("i")) for i, r in enumerate(runs)])
    counts = scored.groupBy("tab").agg(*[F.count_if(F.col("i") == i).alias(f"{name}_texts") for i, name in enumerate(("first", "second", "third"))])
    added = [f"{tab}_{kind}" for tab in tabs for kind in ("GROUP", "SENT_SCORE", "SENT_LABEL")]
    whole = model.transform(df, ["PROTOCOLO"]).select("PROTOCOLO", *[F.col(c).alias(f"__{c}") for c in added])
    both = runs[1].tickets.join(whole, "PROTOCOLO")
    same = [
        F.struct(F.lit(tab).alias("tab"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in added if c.startswith(tab)]).alias("same"))
        for tab in tabs
    ]
    equal = both.select(F.inline(F.array(*same))).groupBy("tab").agg(F.count_if("same").alias("equal_rows"))
    return counts.join(equal, "tab")


@query(
    "X2_own_text_level",
    f"""{X.oracle_views('tickets')} SELECT CANAL, count(*) AS rows, 1 AS groups, CASE CANAL WHEN 'error' THEN -1.0 WHEN 'purchase' THEN 1.0 END::DOUBLE
  AS seed_score FROM tickets GROUP BY CANAL""",
)
def own_text_level(spark, sf_dir):
    """Another text column by parameters alone. A seed that is a text itself scores what it was given."""
    levels = S.text_levels(["CANAL"], {"CANAL": 3}, [("CANAL", "error", -1.0), ("CANAL", "purchase", 1.0)])
    _, enriched = S.enrich(X.tickets(spark, sf_dir), levels, salt_by=["PROTOCOLO"])
    seed_score = F.when(F.col("CANAL").isin("error", "purchase"), F.round("CANAL_SENT_SCORE", 6))
    return enriched.groupBy("CANAL").agg(
        F.count("*").alias("rows"),
        F.count_distinct("CANAL_GROUP").cast("int").alias("groups"),
        F.max(seed_score).alias("seed_score"),
    )


@query("S9_save_load_semantics", f"{_SPLIT_TEXTS} SELECT tab, count(DISTINCT text) AS texts, count(DISTINCT text) AS same FROM texts GROUP BY tab")
def save_load_semantics(spark, sf_dir):
    """A loaded model gives each text what the saved one gave it."""
    model, _ = enriched_tickets(spark, sf_dir)
    path = scratch_path(spark, "semantics")
    S.save_semantics(model, spark, path)
    loaded = S.load_semantics(spark, path)
    dictionary = pinned(S.text_dictionary(X.tickets(spark, sf_dir), list(model.levels)))
    out = None
    for tab in model.levels:
        own = dictionary.filter(F.col("tab") == tab).select("tab", "text")
        before = model.levels[tab].score(own).toDF("tab", "text", "cluster", "label", "score", "mood")
        after = loaded.levels[tab].score(own)
        joined = before.join(after, ["tab", "text"])
        same = (
            F.col("cluster").eqNullSafe(F.col("cluster_id"))
            & F.col("label").eqNullSafe(F.col("semantic_group"))
            & F.col("score").eqNullSafe(F.col("sentiment_score"))
            & F.col("mood").eqNullSafe(F.col("sentiment_label"))
        )
        part = joined.groupBy("tab").agg(F.count("*").alias("texts"), F.count_if(same).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ boosted trees
TREES = params.BOOSTING["trees"]
_LABELLED_BY_ONE = """CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"""


def known_tickets(spark, sf_dir):
    """Tickets whose cancellation one numeric column decides, so that what is learned is known beforehand."""
    decides = F.col("PROTOCOLO") % 5 == 0
    tickets = X.tickets(spark, sf_dir).withColumn("MESES", F.when(decides, 1).otherwise(0))
    return tickets.withColumn("ULTIMO_CANCELAMENTO", F.when(decides, F.coalesce("DATA_REGISTRO", F.current_timestamp().cast("timestamp_ntz"))))


def known_features(spark, sf_dir):
    """All row features of these tickets, with their groups and moods; without identifiers."""
    return drop_leaks(build_features(X.as_semantic(known_tickets(spark, sf_dir))), [c for c in params.LEAK_COLUMNS if c != params.TICKET])


_KNOWN: dict[tuple[str, str], training.TrainingRun] = {}


def known_training(spark, sf_dir) -> training.TrainingRun:
    """The production training on all row features, all trees, once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = training.train(stratified_split(known_features(spark, sf_dir)).drop(params.TICKET))
    return _KNOWN[key]


@query("M15_boosted_trees", f"SELECT {TREES}::BIGINT * max({_LABELLED_BY_ONE}) AS trees, {TREES}::BIGINT * max({_LABELLED_BY_ONE}) AS led_by_it FROM events")
def boosted_trees(spark, sf_dir):
    """All trees are fitted, and the deciding column leads in each of them."""
    done = known_training(spark, sf_dir)
    leading = [done.inputs[int(t.featureImportances.toArray().argmax())] for t in done.model.stages[-1].trees if t.depth > 0]
    trees = spark.createDataFrame([(name,) for name in leading], "leading string")
    return trees.agg(F.count("*").alias("trees"), F.count_if(F.col("leading") == "MESES").alias("led_by_it"))


@query(
    "M16_predict_probability",
    f"{X.oracle_views('split_semantic')} SELECT split, count(*) AS rows, count(*) AS valid FROM split_semantic GROUP BY split",
)
def predict_probability(spark, sf_dir):
    whole = trained(spark, sf_dir)
    scored = training.predict(whole.training.model, feature_matrix(whole.features))
    return scored.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if((F.col("p") >= 0) & (F.col("p") <= 1)).alias("valid")
    )


_KNOWN_IMPORTANCES = f"""SELECT feature, CASE WHEN feature = 'MESES' THEN CAST(max({_LABELLED_BY_ONE}) AS DOUBLE) ELSE 0.0::DOUBLE END AS importance
FROM events, (VALUES {', '.join(f"('{n}')" for n in INPUTS)}) t(feature) GROUP BY feature"""


def known_importances(spark, sf_dir):
    """The deciding column has all the importance, the other inputs none."""
    return known_training(spark, sf_dir).importances


@query("M17_feature_importances", _KNOWN_IMPORTANCES)
def feature_importances(spark, sf_dir):
    return rounded(known_importances(spark, sf_dir), "importance")


@query("S7_write_importances", _KNOWN_IMPORTANCES)
def importances_written(spark, sf_dir):
    path = write_importances(known_importances(spark, sf_dir), scratch_path(spark, "importances.csv"))
    return rounded(read_table(spark, path, schema=training.schemas.IMPORTANCES), "importance")


@query(
    "S10_save_load_model",
    f"{X.oracle_views('split_semantic')} SELECT split, count(*) AS rows, count(*) AS same FROM split_semantic GROUP BY split",
)
def save_load_model(spark, sf_dir):
    """A loaded model gives each ticket the probability the saved one gave it."""
    whole = trained(spark, sf_dir)
    path = scratch_path(spark, "model")
    training.save_model(whole.training.model, path)
    matrix = feature_matrix(whole.features)
    before = whole.training.model.transform(matrix).select("split", "features", "label", F.col("probability").alias("was"))
    after = training.load_model(path).stages[-1].transform(before)
    gap = F.abs(vector_to_array("probability")[1] - vector_to_array("was")[1])
    return after.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(gap == 0).alias("same"))


@query(
    "S10_published_scorer",
    f"{X.oracle_views('split_semantic')} SELECT count(*) AS rows, count(*) AS same, 2 AS versions FROM split_semantic",
)
def published_scorer(spark, sf_dir):
    """Text levels and trees published twice, a third time by a writer that dies; every ticket then scores as by the second."""
    whole = trained(spark, sf_dir)
    semantics, model = whole.semantics, whole.training.model
    path = scratch_path(spark, "scorer")
    scoring.save_scorer(S.SemanticModel({"TAB_N1": semantics.levels["TAB_N1"]}), model, spark, path)
    scoring.save_scorer(semantics, model, spark, path)

    def dies(folder: str) -> None:
        S.write_semantics(semantics, spark, f"{folder}/semantics")
        raise RuntimeError("killed")

    try:
        published.publish(spark, path, dies)
    except RuntimeError:
        pass
    tickets = X.tickets(spark, sf_dir).withColumn("TARGET", F.lit(0)).drop("ID_CLIENTE", "CODIGO", "NUMERO_OS")
    carry = ["PROTOCOLO"]
    now = scoring.score_tickets(tickets, *scoring.load_scorer(spark, path), "TARGET", carry).select("PROTOCOLO", F.col("p").alias("now"))
    both = scoring.score_tickets(tickets, semantics, model, "TARGET", carry).join(now, "PROTOCOLO")
    return both.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("p") == F.col("now")).alias("same"),
        F.lit(published.versions(spark, path).count()).cast("int").alias("versions"),
    )


@query(
    "M18_training_run",
    f"""{X.oracle_views('split_semantic')} SELECT split, count(*) AS rows, CAST(sum(TARGET) AS BIGINT) AS positives, true AS valid
FROM split_semantic GROUP BY split""",
)
def training_run(spark, sf_dir):
    """Every row of every split is evaluated, at one of the thresholds, with metrics between 0 and 1."""
    result = trained(spark, sf_dir).training
    table = M.evaluate(result.scored, result.threshold)
    valid = F.lit(result.threshold).isin(*params.DECISION_THRESHOLDS, params.FALLBACK_THRESHOLD)
    for name in ("auc_roc", "precision", "recall", "f1_score"):
        valid = valid & F.col(name).between(0, 1)
    return table.select(
        "split",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        valid.alias("valid"),
    )


_PERFECT = f"""SELECT dataset, CAST(max({_LABELLED_BY_ONE}) AS DOUBLE) AS auc_roc, CAST(max({_LABELLED_BY_ONE}) AS DOUBLE) AS precision,
  CAST(max({_LABELLED_BY_ONE}) AS DOUBLE) AS recall, CAST(max({_LABELLED_BY_ONE}) AS DOUBLE) AS f1_score, 0.1::DOUBLE AS threshold
FROM events, (VALUES ('train'), ('validation'), ('test')) t(dataset) GROUP BY dataset"""


@query("M18_training_metrics", _PERFECT)
def training_metrics(spark, sf_dir):
    """Metrics of each split at the threshold chosen on validation; of equally good thresholds the lowest is chosen."""
    result = known_training(spark, sf_dir)
    return rounded(result.metrics, "auc_roc", "precision", "recall", "f1_score").withColumn("threshold", F.lit(result.threshold))


_KNOWN_RUNS: dict[tuple[str, str], Run] = {}


def known_run(spark, sf_dir) -> Run:
    """A full run from raw tickets whose label is known, once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN_RUNS:
        _KNOWN_RUNS[key] = run(known_tickets(spark, sf_dir))
    return _KNOWN_RUNS[key]


_STORED_ROWS = ", ".join(f"('{d}', {a}::DOUBLE, {p}::DOUBLE, {r}::DOUBLE, {f}::DOUBLE)" for d, a, p, r, f in params.STORED_METRICS)


@query(
    "M19_end_to_end_run",
    f"""WITH known AS (SELECT CAST(max({_LABELLED_BY_ONE}) AS DOUBLE) AS one FROM events)
SELECT dataset, one AS auc_roc, one AS precision, one AS recall, one AS f1_score,
  a AS stored_auc_roc, p AS stored_precision, r AS stored_recall, f AS stored_f1_score,
  round(one - a, 6) AS delta_auc_roc, round(one - p, 6) AS delta_precision, round(one - r, 6) AS delta_recall, round(one - f, 6) AS delta_f1_score
FROM known, (VALUES {_STORED_ROWS}) t(dataset, a, p, r, f)""",
)
def end_to_end_run(spark, sf_dir):
    """The report's comparison table at the end of a run from raw tickets whose label is known."""
    table = known_run(spark, sf_dir).reports["comparison"]
    names = ("auc_roc", "precision", "recall", "f1_score")
    return rounded(table, *names, *[f"delta_{n}" for n in names])


@query("D4_logistic_baseline", _PERFECT)
def logistic_baseline(spark, sf_dir):
    split = stratified_split(known_features(spark, sf_dir)).drop(params.TICKET)
    result = training.train(split, pipeline=training.logistic_baseline)
    return rounded(result.metrics, "auc_roc", "precision", "recall", "f1_score").withColumn("threshold", F.lit(result.threshold))


_FOLDS = 3


def _deal(folds: int) -> str:
    """Customers in dealing order, and every round played one after another: the fold of each place of a round."""
    return f"""customers AS (
  SELECT ID_CLIENTE, count(*) AS rows, CAST(sum(TARGET) AS BIGINT) AS positives, md5(concat(CAST(ID_CLIENTE AS string), ':42')) AS h FROM known GROUP BY ID_CLIENTE),
dealt AS (SELECT *, row_number() OVER (ORDER BY positives DESC, rows DESC, h) - 1 AS place FROM customers),
seats AS (SELECT *, place // {folds} AS round, row_number() OVER (PARTITION BY place // {folds} ORDER BY rows DESC, place) AS seat FROM dealt),
rounds AS (SELECT round, list(rows ORDER BY seat) AS sizes FROM seats GROUP BY round),
played AS (
  SELECT CAST(-1 AS BIGINT) AS round, [CAST(0 AS BIGINT) FOR x IN range({folds})] AS loads, CAST([] AS BIGINT[]) AS folds
  UNION ALL
  SELECT r.round, [coalesce(p.loads[f + 1] + r.sizes[list_position(o.folds, f)], p.loads[f + 1]) FOR f IN range({folds})], o.folds
  FROM played p JOIN rounds r ON r.round = p.round + 1,
    LATERAL (SELECT [x % {folds} FOR x IN list_sort([p.loads[f + 1] * {folds} + f FOR f IN range({folds})])] AS folds) o)"""


def _known(folds: int) -> str:
    views = X.oracle_views("tickets").replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{views}, known AS (SELECT PROTOCOLO, ID_CLIENTE, {_LABELLED_BY_ONE.replace('event_id', 'PROTOCOLO')} AS TARGET FROM tickets), {_deal(folds)},
placed AS (SELECT PROTOCOLO, known.ID_CLIENTE, TARGET, CAST(p.folds[seat] AS INTEGER) AS fold
  FROM known JOIN seats USING (ID_CLIENTE) JOIN played p ON p.round = seats.round)"""


def _folded(spark, sf_dir, folds):
    tickets = X.as_semantic(known_tickets(spark, sf_dir))
    return stratified_customer_folds(tickets, folds, salt_by=["PROTOCOLO"])


@query("D3_stratified_folds", f"{_known(5)} SELECT PROTOCOLO, ID_CLIENTE, TARGET, fold FROM placed")
def stratified_folds(spark, sf_dir):
    """Folds by customer, even in rows and in positives."""
    return _folded(spark, sf_dir, 5).select("PROTOCOLO", "ID_CLIENTE", "TARGET", "fold")


@query(
    "D3_fold_balance",
    f"""{_known(5)} SELECT fold, count(*) AS rows, CAST(sum(TARGET) AS BIGINT) AS positives, count(DISTINCT ID_CLIENTE) AS customers, 0::BIGINT AS shared_customers
FROM placed GROUP BY fold""",
)
def folds_in_balance(spark, sf_dir):
    return fold_balance(_folded(spark, sf_dir, 5))


@query(
    "D3_cross_validation",
    f"{_known(_FOLDS)} SELECT fold, count(*) AS rows, CAST(sum(TARGET) AS BIGINT) AS positives, 1.0::DOUBLE AS auc_roc FROM placed GROUP BY fold",
)
def cross_validation(spark, sf_dir):
    """All trees on all row features, fitted on the other folds; one column decides the label, so each fold's AUC is 1."""
    folded = stratified_customer_folds(X.as_semantic(known_tickets(spark, sf_dir)), _FOLDS, salt_by=["PROTOCOLO"])
    matrix = evened(pinned(feature_matrix(drop_leaks(build_features(folded)), carry=["fold"])))
    scored = training.out_of_fold(matrix, input_names(matrix, ["fold"]), _FOLDS, parallelism=_FOLDS)
    return rounded(training.evaluate_folds(scored), "auc_roc")


@query(
    "D5_rolling_origin",
    f"""{X.oracle_views('tickets')}, w AS (SELECT CAST(date_trunc('week', DATA_REGISTRO) AS DATE) AS period, count(*) AS rows,
  CAST(sum({_LABELLED_BY_ONE.replace('event_id', 'PROTOCOLO')}) AS BIGINT) AS positives FROM tickets WHERE DATA_REGISTRO IS NOT NULL GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY period) AS place FROM w)
SELECT o.period AS origin, CAST(p.place - o.place + 1 AS INTEGER) AS ahead, p.period, p.rows, p.positives, 1.0::DOUBLE AS auc_roc, 0.0::DOUBLE AS auc_decay
FROM n o JOIN n p ON p.place BETWEEN o.place AND o.place + 1 WHERE o.place > 1""",
)
def rolling_origin(spark, sf_dir):
    """A linear model per week, fitted on all weeks before it, scores that week and the next one."""
    tickets = known_tickets(spark, sf_dir)
    at = with_period(tickets.select(params.TICKET, "DATA_REGISTRO"), "DATA_REGISTRO", "week").select(params.TICKET, "period")
    labelled = drop_leaks(build_features(X.as_semantic(tickets).join(at, params.TICKET)))
    matrix = pinned(feature_matrix(labelled, carry=["period"]))
    scored = temporal.rolling_origin(matrix, input_names(matrix, ["period"]), 2, training.logistic_baseline, parallelism=4)
    by_week = temporal.metrics_per_period(pinned(scored), 0.5, ["origin", "ahead"])
    return rounded(by_week.select("origin", "ahead", "period", "rows", "positives", "auc_roc", "auc_decay"), "auc_roc", "auc_decay")


class _Stopped(Exception):
    """What a query fails with to be started again."""


def stopping_once(output, transform):
    """Writes batches like the library, and fails after the second batch is written and before it counts as done."""
    write, stopped = scoring.write_batches(output, transform), []

    def fails(batch, number):
        write(batch, number)
        if number == 1 and not stopped:
            stopped.append(number)
            raise _Stopped

    return fails


@query(
    "ST1_scored_stream",
    f"SELECT event_id AS PROTOCOLO, {_LABELLED_BY_ONE} AS decision, true AS like_batch FROM events",
)
def scored_stream(spark, sf_dir):
    """Raw tickets as a stream of files, some of them repeated, to probabilities; the query fails in the middle and is started again."""
    whole = known_run(spark, sf_dir)
    tickets = dealt(known_tickets(spark, sf_dir).withColumn("TARGET", F.lit(0)).drop("ID_CLIENTE", "CODIGO", "NUMERO_OS"))
    folder, output, checkpoint = (scratch_path(spark, name) for name in ("raw", "scored", "progress"))
    half, files = F.col(params.TICKET) % 2 == 0, 0
    for part in (half, ~half, F.col(params.TICKET) % 3 == 0):  # the last files repeat tickets
        tickets.filter(part).write.mode("append").parquet(folder)
        files = files or len(spark.read.schema(tickets.schema).parquet(folder).inputFiles())
    source = spark.readStream.schema(tickets.schema).option("maxFilesPerTrigger", files).parquet(folder)
    common = (source, whole.semantics, whole.training.model, output, checkpoint, "TARGET", params.TICKET, "DATA_REGISTRO", "60 days")
    try:
        scoring.score_stream(*common, write=stopping_once)
        raise AssertionError("the query was to fail")
    except StreamingQueryException:
        scoring.score_stream(*common)
    streamed = spark.read.parquet(output).select(params.TICKET, F.col("p").alias("streamed"))
    batch = scoring.score_tickets(tickets, whole.semantics, whole.training.model, "TARGET", [params.TICKET])
    both = streamed.join(batch, params.TICKET, "full")
    decision = (F.col("streamed") >= whole.training.threshold).cast("int")
    return both.select(params.TICKET, decision.alias("decision"), (F.col("streamed") == F.col("p")).alias("like_batch"))
