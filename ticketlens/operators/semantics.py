"""Meaning and mood of short category texts: cluster, score and label for each text level.

Everything is fitted on and applied to a dictionary of distinct texts with their row counts; the tickets only
meet the finished dictionary, in one join per level.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import params, schemas
from ticketlens.functions.text import label_sentiment, prepare_text
from ticketlens.functions.vectors import all_distances, is_vector, project_score
from ticketlens.operators.clusters import cluster_keywords
from ticketlens.operators.direction import seed_direction
from ticketlens.operators.encoders import EMBEDDING, fit_hashed_tfidf, load_encoder, save_encoder
from ticketlens.operators.joins import lookup_join
from ticketlens.runtime import in_memory, local_table, pinned, shuffle_parts
from ticketlens.sources.published import current, publish
from ticketlens.sources.tables import read_table, write_table

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class TextLevel:
    """How one text column is treated: number of clusters and sentiment seeds."""

    tab: str
    clusters: int = params.DEFAULT_CLUSTERS
    seeds: tuple[tuple[str, float], ...] = ()


def text_levels(
    tabs: Sequence[str] | None = None,
    clusters: Mapping[str, int] = params.CLUSTERS_PER_TAB,
    seeds: Sequence[tuple[str, str, float]] = tuple(params.SENTIMENT_SEEDS),
) -> list[TextLevel]:
    """Levels from the parameter tables; a column without parameters is an error."""
    chosen = list(tabs) if tabs is not None else list(clusters)
    unknown = [tab for tab in chosen if tab not in clusters]
    if unknown:
        raise ValueError(f"no parameters for text column {unknown[0]}; known: {sorted(clusters)}")
    return [TextLevel(t, clusters[t], tuple((s, v) for tab, s, v in seeds if tab == t)) for t in chosen]


def text_dictionary(
    df: DataFrame, tabs: Sequence[str], null_text: str = "nan", fit_on: str | None = "train"
) -> DataFrame:
    """Distinct texts of all levels in one pass: (tab, text, n, n_fit). Without a level the table is empty.

    ``n_fit`` counts the rows of the split the model is fitted on (all rows if there is no split column).
    """
    fitted = F.col("split") == fit_on if fit_on is not None and "split" in df.columns else F.lit(True)
    if not tabs:
        return df.sparkSession.createDataFrame([], "tab string, text string, n long, n_fit long")
    entries = F.array(
        *[F.struct(F.lit(t).alias("tab"), prepare_text(t, null_text).alias("text")) for t in tabs]
    )
    return (
        df.select(fitted.cast("long").alias("fit"), F.inline(entries))
        .groupBy("tab", "text")
        .agg(F.count("*").alias("n"), F.sum("fit").alias("n_fit"))
    )


def cluster_count(wanted: int, rows: int, texts: int) -> int:
    """At most one cluster per row and per distinct text, at least two."""
    return max(2, min(wanted, max(2, rows), texts))


def fit_clusters(
    encoded: DataFrame, k: int, n: str = "n", seed: int = params.SEED, iterations: int = 300
) -> KMeansModel | GivenCentroids:
    """k-means over distinct texts, each weighted with its rows: the same optimum as over all rows.

    Texts that all have one vector are one cluster. Each round reads the vectors from memory and, as far as they don't fit there, from where
    ``encoded`` has them; k-means left to itself would write those to disk at full width.
    """
    plain = F.unwrap_udt(EMBEDDING) if is_vector(encoded, EMBEDDING) else F.col(EMBEDDING)
    hashed = encoded.select(F.xxhash64(plain).alias("hash"), EMBEDDING)
    first = hashed.first()
    if first is not None and not hashed.filter(F.col("hash") != first.hash).take(1):
        only = first[EMBEDDING]
        return GivenCentroids((tuple(float(v) for v in (only.toArray() if hasattr(only, "toArray") else only)),))
    means = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol=EMBEDDING, predictionCol="cluster_id", weightCol=n)
    with in_memory(encoded.select(EMBEDDING, n)) as rows:
        return means.fit(rows)


@dataclass(frozen=True)
class GivenCentroids:
    """Centroids from elsewhere in place of a fitted k-means model."""

    centroids: tuple[tuple[float, ...], ...]

    def clusterCenters(self) -> list[tuple[float, ...]]:
        return list(self.centroids)

    def transform(self, df: DataFrame) -> DataFrame:
        distances = all_distances(EMBEDDING, self.centroids, is_vector(df, EMBEDDING))
        measured = df.withColumn("__distances", distances)
        nearest = F.array_position("__distances", F.array_min("__distances")) - 1  # the lowest id among equals
        return measured.withColumn("cluster_id", nearest.cast("int")).drop("__distances")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, list(c)) for i, c in enumerate(self.centroids)]
        write_table(spark.createDataFrame(rows, "cluster_id int, centroid array<double>").coalesce(1), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "GivenCentroids":
        rows = read_table(spark, path).orderBy("cluster_id").collect()
        return GivenCentroids(tuple(tuple(r.centroid) for r in rows))


def group_centroids(df: DataFrame, group: str, embedding: str = EMBEDDING) -> list[tuple[int, list[float]]]:
    """Mean embedding per group, by group; as many rows as the model that is made of them has centroids."""
    vectors = F.col(embedding) if is_vector(df, embedding) else array_to_vector(F.col(embedding).cast("array<double>"))
    means = df.groupBy(group).agg(Summarizer.mean(vectors).alias("mean"))
    rows = means.select(group, vector_to_array("mean").alias("mean")).collect()
    return sorted((r[0], list(r[1])) for r in rows)


@dataclass(frozen=True)
class LevelModel:
    """A fitted text level."""

    tab: str
    encoder: object
    kmeans: KMeansModel | GivenCentroids
    labels: tuple[tuple[int, str], ...]
    weights: tuple[float, ...] | None
    bounds: tuple[float, float] = params.SENTIMENT_BOUNDS

    def label_table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.tab, i, label) for i, label in self.labels]
        return local_table(spark, rows, schemas.CLUSTER_DICTIONARY)

    def _label(self) -> Column:
        """The label of a cluster id as an expression: a join would keep every level before it in the counts of the next."""
        default = F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))
        if not self.labels:
            return default
        labels = F.create_map(*[F.lit(x) for i, label in self.labels for x in (int(i), label)])
        return F.coalesce(F.try_element_at(labels, F.col("cluster_id")), default)

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add cluster_id, semantic_group, sentiment_score and sentiment_label. Row by row, so fit for streams.

        A text without an embedding has no cluster and no score.
        """
        encoded = self.encoder.encode(df, text).withColumn("__known", F.col(EMBEDDING).isNotNull())
        vector = is_vector(encoded, EMBEDDING)
        blank = F.array_repeat(F.lit(0.0).cast("double" if vector else "float"), len(self.kmeans.clusterCenters()[0]))
        blank = array_to_vector(blank) if vector else blank
        assigned = self.kmeans.transform(encoded.withColumn(EMBEDDING, F.coalesce(EMBEDDING, blank)))
        assigned = assigned.withColumn("cluster_id", F.when(F.col("__known"), F.col("cluster_id")))
        named = assigned.withColumn("semantic_group", self._label())
        score = F.when(F.col("__known"), project_score(EMBEDDING, self.weights, vector))
        return (
            named.withColumn("sentiment_score", score)
            .withColumn("sentiment_label", label_sentiment("sentiment_score", self.bounds))
            .select(*df.columns, "cluster_id", "semantic_group", "sentiment_score", "sentiment_label")
        )


def fit_level(
    dictionary: DataFrame,
    level: TextLevel,
    fit_encoder: Callable = fit_hashed_tfidf,
    n: str = "n",
    seed: int = params.SEED,
    bounds: tuple[float, float] = params.SENTIMENT_BOUNDS,
) -> tuple[LevelModel, DataFrame]:
    """Fit one level on its (text, n) dictionary: the model, still without cluster labels, and the clustered texts."""
    spark = dictionary.sparkSession
    size = dictionary.agg(F.count("*"), F.sum(n)).first()
    texts, rows = size[0], size[1] or 0
    if rows == 0:
        raise ValueError(f"no texts to fit {level.tab} on")
    # A fixed placement and order of the texts makes the fit repeatable.
    placed = dictionary.select("text", n).repartition(shuffle_parts(spark), "text").sortWithinPartitions("text")
    encoder = fit_encoder(placed)
    encoded = pinned(encoder.encode(placed, "text").filter(F.col(EMBEDDING).isNotNull()))
    if not encoded.take(1):
        raise ValueError(f"no texts to fit {level.tab} on: none of them has an embedding")
    kmeans = fit_clusters(encoded, cluster_count(level.clusters, rows, texts), n, seed)
    weights = None
    if level.seeds:
        seeds = local_table(spark, [(level.tab, s, v) for s, v in level.seeds], schemas.SEEDS)
        weights = seed_direction(encoder.encode(seeds, "seed_text"))
    model = LevelModel(level.tab, encoder, kmeans, (), tuple(weights) if weights is not None else None, bounds)
    clustered = kmeans.transform(encoded).select(F.lit(level.tab).alias("tab"), "cluster_id", "text", F.col(n).alias("n"))
    return model, clustered


def name_clusters(models: Sequence[tuple[LevelModel, DataFrame]]) -> dict[str, LevelModel]:
    """Give the clusters of all levels their keyword labels, in one pass over the clustered dictionaries."""
    clustered = reduce(DataFrame.unionByName, [texts for _, texts in models])
    labels = cluster_keywords(clustered, ["tab", "cluster_id"], "text", "text", "n").collect()  # a row per centroid of the models
    return {
        model.tab: replace(model, labels=tuple(sorted((r.cluster_id, r.label) for r in labels if r.tab == model.tab)))
        for model, _ in models
    }


@dataclass(frozen=True)
class SemanticModel:
    """Fitted levels by text column."""

    levels: dict[str, LevelModel]
    null_text: str = "nan"

    def cluster_dictionary(self, spark: SparkSession) -> DataFrame:
        rows = [(m.tab, i, label) for m in self.levels.values() for i, label in m.labels]
        return local_table(spark, rows, schemas.CLUSTER_DICTIONARY)

    def transform(
        self, df: DataFrame, salt_by: Sequence[str] | None = None, dictionary: DataFrame | None = None
    ) -> DataFrame:
        """Append ``_GROUP``, ``_SENT_SCORE``, ``_SENT_LABEL`` and ``_CLUSTER`` (its id) for each level the table has."""
        present = self._present(df) if self.levels or dictionary is None else []
        if not present:
            return df
        if dictionary is None:
            dictionary = pinned(text_dictionary(df, present, self.null_text))
        return self._attach(df, present, pinned(self._scored(dictionary, present)), salt_by)

    def key(self) -> str:
        """Tells fitted models apart, by their labels, directions, bounds and centroids."""
        found = hashlib.md5(self.null_text.encode())
        for tab, level in sorted(self.levels.items()):
            found.update(repr((tab, level.labels, level.weights, tuple(level.bounds))).encode())
            for centre in level.kmeans.clusterCenters():
                found.update(np.asarray(centre, float).tobytes())
        return found.hexdigest()

    def _scored(self, dictionary: DataFrame, present: Sequence[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.levels[tab].score(dictionary.filter(F.col("tab") == tab)) for tab in present])

    def _attach(self, df: DataFrame, present: Sequence[str], named: DataFrame, salt_by: Sequence[str] | None) -> DataFrame:
        """The tickets with the columns that ``named`` holds for their texts."""
        out = df
        for tab in present:
            lookup = named.filter(F.col("tab") == tab).select(
                F.col("text").alias("__text"),
                F.col("semantic_group").alias(f"{tab}_GROUP"),
                F.col("sentiment_score").alias(f"{tab}_SENT_SCORE"),
                F.col("sentiment_label").alias(f"{tab}_SENT_LABEL"),
                F.col("cluster_id").alias(f"{tab}{params.CLUSTER_SUFFIX}"),
                "n",
            )
            keyed = out.withColumn("__text", prepare_text(tab, self.null_text))
            out = lookup_join(keyed, lookup, ["__text"], "n", salt_by or df.columns).drop("__text")
        return out

    def transform_rows(self, df: DataFrame) -> DataFrame:
        """The same columns computed row by row, without a dictionary: for streams."""
        out = df
        for tab in self._present(df):
            keyed = out.withColumn("__text", prepare_text(tab, self.null_text))
            out = self.levels[tab].score(keyed, "__text").select(
                *out.columns,
                F.col("semantic_group").alias(f"{tab}_GROUP"),
                F.col("sentiment_score").alias(f"{tab}_SENT_SCORE"),
                F.col("sentiment_label").alias(f"{tab}_SENT_LABEL"),
                F.col("cluster_id").alias(f"{tab}{params.CLUSTER_SUFFIX}"),
            )
        return out

    def _present(self, df: DataFrame) -> list[str]:
        if not self.levels:
            raise ValueError("the semantic model has not been fitted")
        for tab in self.levels:
            if tab not in df.columns:
                log.warning("column %s is missing and is skipped", tab)
        return [tab for tab in self.levels if tab in df.columns]


def fit_semantics(
    df: DataFrame,
    levels: Sequence[TextLevel] | None = None,
    fit_encoder: Callable = fit_hashed_tfidf,
    null_text: str = "nan",
    seed: int = params.SEED,
    dictionary: DataFrame | None = None,
) -> SemanticModel:
    """One model per text column, fitted on the train split (on all rows without one). Absent columns are skipped."""
    levels = list(levels) if levels is not None else text_levels()
    present = [level for level in levels if level.tab in df.columns]
    for level in levels:
        if level not in present:
            log.warning("column %s is missing and is skipped", level.tab)
    if dictionary is None:
        dictionary = pinned(text_dictionary(df, [level.tab for level in present], null_text))
    fitted = dictionary.filter(F.col("n_fit") > 0).select("tab", "text", F.col("n_fit").alias("n"))
    models = [fit_level(fitted.filter(F.col("tab") == x.tab), x, fit_encoder, seed=seed) for x in present]
    return SemanticModel(name_clusters(models) if models else {}, null_text)


def enrich(
    df: DataFrame,
    levels: Sequence[TextLevel] | None = None,
    fit_encoder: Callable = fit_hashed_tfidf,
    null_text: str = "nan",
    salt_by: Sequence[str] | None = None,
) -> tuple[SemanticModel, DataFrame]:
    """Fit on the train split, then enrich all splits; one dictionary serves both."""
    levels = list(levels) if levels is not None else text_levels()
    tabs = [level.tab for level in levels if level.tab in df.columns]
    dictionary = pinned(text_dictionary(df, tabs, null_text))
    model = fit_semantics(df, levels, fit_encoder, null_text, dictionary=dictionary)
    return model, model.transform(df, salt_by, dictionary)


_SCORED_TEXT = "text string, cluster_id int, semantic_group string, sentiment_score double, sentiment_label string, model string, tab string"


@dataclass(frozen=True)
class GrownEnrichment:
    """Enriched tickets, and the texts (tab, text, n) that were scored for them."""

    tickets: DataFrame
    new_texts: DataFrame


def stored_texts(spark: SparkSession, path: str, model: SemanticModel) -> DataFrame:
    """The texts that were scored with this model, one row each; none where nothing is stored yet."""
    try:
        found = spark.read.schema(_SCORED_TEXT).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], _SCORED_TEXT)
    return found.filter(F.col("model") == model.key()).drop("model").dropDuplicates(["tab", "text"])


def enrich_growing(model: SemanticModel, df: DataFrame, path: str, salt_by: Sequence[str] | None = None) -> GrownEnrichment:
    """``model.transform(df)``, with the scored texts kept as a table at ``path``: only texts it lacks are encoded, and appended.

    Rows carry the key of their model, so texts of another fit do not count as known. A text that is appended twice, by two runs at once
    or by one that was repeated, counts once. Columns that ``df`` lacks are skipped.
    """
    present = model._present(df)
    if not present:
        return GrownEnrichment(df, text_dictionary(df, []).select("tab", "text", "n"))
    spark = df.sparkSession
    dictionary = pinned(text_dictionary(df, present, model.null_text).select("tab", "text", "n"))
    new = pinned(dictionary.join(stored_texts(spark, path, model), ["tab", "text"], "left_anti"))
    if new.take(1):
        rows = model._scored(new, present).withColumn("model", F.lit(model.key()))
        columns = [F.col(f.split()[0]).cast(f.split()[1]) for f in _SCORED_TEXT.split(", ")]
        rows.select(*columns).write.mode("append").partitionBy("model", "tab").parquet(path)
    named = pinned(dictionary.join(stored_texts(spark, path, model), ["tab", "text"]))
    return GrownEnrichment(model._attach(df, present, named, salt_by), new)


def sparse_weights(weights: Sequence[float] | None) -> tuple[int | None, list[int] | None, list[float] | None]:
    """(size, places, values) of a direction, which has as many entries other than 0 as its seeds have."""
    if weights is None:
        return None, None, None
    places = np.flatnonzero(weights)
    return len(weights), [int(i) for i in places], [float(weights[i]) for i in places]


def full_weights(size: int | None, places: Sequence[int] | None, values: Sequence[float] | None) -> tuple[float, ...] | None:
    if size is None:
        return None
    out = np.zeros(size)
    out[places] = values
    return tuple(out.tolist())


def save_semantics(model: SemanticModel, spark: SparkSession, path: str) -> int:
    """Publish the model whole, as the next version at ``path``: a save that dies leaves the version before it."""
    return publish(spark, path, lambda folder: write_semantics(model, spark, folder))


def load_semantics(
    spark: SparkSession, path: str, tabs: Sequence[str] | None = None, encoder: object | None = None
) -> SemanticModel:
    """The last published version, its files compared with their checksums. Parameters as in ``read_semantics``."""
    return read_semantics(spark, current(spark, path), tabs, encoder)


def write_semantics(model: SemanticModel, spark: SparkSession, path: str) -> None:
    """Each level as its encoder, its k-means model and two small tables."""
    if not model.levels:
        raise ValueError("the semantic model has not been fitted")
    for tab, level in model.levels.items():
        base = f"{path}/{tab}"
        save_encoder(level.encoder, spark, base)
        given = isinstance(level.kmeans, GivenCentroids)
        if given:
            level.kmeans.save(spark, f"{base}/centroids")
        else:
            level.kmeans.write().overwrite().save(f"{base}/kmeans")
        write_table(level.label_table(spark), f"{base}/labels")
        row = [(tab, model.null_text, *sparse_weights(level.weights), *level.bounds, given)]
        columns = "tab string, null_text string, size int, places array<int>, weights array<double>, low double, high double, given boolean"
        write_table(spark.createDataFrame(row, columns), f"{base}/sentiment")
    write_table(spark.createDataFrame([(tab,) for tab in model.levels], "tab string").coalesce(1), f"{path}/levels")


def read_semantics(
    spark: SparkSession, path: str, tabs: Sequence[str] | None = None, encoder: object | None = None
) -> SemanticModel:
    """The stored levels, or those of ``tabs`` that are stored; ``encoder`` for levels whose encoder holds code."""
    stored = [r.tab for r in read_table(spark, f"{path}/levels").collect()]
    levels, null_text = {}, "nan"
    for tab in stored if tabs is None else tabs:
        if tab not in stored:
            log.warning("level %s is not in the stored model and is skipped", tab)
            continue
        base = f"{path}/{tab}"
        row = read_table(spark, f"{base}/sentiment").first()
        labels = read_table(spark, f"{base}/labels").select("cluster_id", "label").collect()
        null_text = row.null_text
        levels[tab] = LevelModel(
            tab,
            load_encoder(spark, base, encoder),
            GivenCentroids.load(spark, f"{base}/centroids") if row.given else KMeansModel.load(f"{base}/kmeans"),
            tuple(sorted((r.cluster_id, r.label) for r in labels)),
            full_weights(row.size, row.places, row.weights),
            (row.low, row.high),
        )
    return SemanticModel(levels, null_text)
