"""Keyword labels and statistics of text clusters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ticketlens import params
from ticketlens.functions.text import has_token
from ticketlens.operators import term_blocks as B
from ticketlens.operators.joins import lookup_join
from ticketlens.runtime import bounded, settings, ship_package, written


#: Slices of the vocabulary that are weighed one after another, each with this many bytes of words at least.
SLICES = 2
SLICE_BYTES = 8 << 20
#: Texts a worker gets at a time.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def term_scores(
    texts: DataFrame, group: Sequence[str], key: str, text: str = "text", n: str = "n", best: int | None = None
) -> DataFrame:
    """Mean TF-IDF of each term within each group, as (group, term, score).

    ``texts`` has a row per distinct text: group columns, a text key, the text, and how many rows carry it. Every
    group is a corpus of its own. Smooth idf, unit-length text vectors, mean over all rows of the group. With ``best``
    all are computed, but only terms that can be among so many best ones of their group become rows.

    The terms of all texts take many times the room of the texts, so texts stay where they are, in blocks. A block sends each of its
    terms once, as a hash, and gets back how many rows have it in all; with these it weighs its texts and adds up its share of each score.
    Shares of terms that several blocks have are sent too, and one of these blocks gets the sum. The vocabulary is cut into slices that
    go one after another, first for the lengths of the text vectors, then for the scores. Only one slice is sent at a time.
    """
    group, spark = list(group), texts.sparkSession
    ship_package(spark)
    corpus = bounded(texts.groupBy(*group).agg(F.sum(n).alias("rows"), F.count("*").alias("texts")))
    plain = texts.select(*group, F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.col(text).alias("text"))
    known = lookup_join(plain, corpus, group, "texts", ["n"])
    with settings(spark, **{_BATCH: str(BATCH_ROWS)}):
        blocks = written(known.mapInArrow(B.cut_blocks, B.BLOCK_SCHEMA), "blocks")
    count, size = blocks.agg(F.sum("words"), F.sum("bytes")).first()
    slices = min(SLICES, max(1, -(-(size or 0) // SLICE_BYTES)))
    buckets = min(B.MOST_BUCKETS, max(1, -(-2 * (count or 0) // (slices * B.BUCKET_TERMS))))
    blocks = blocks.select("block", "body")

    def with_blocks(rows: DataFrame, function, schema) -> DataFrame:
        """``function(block, its body, its rows)`` for each block."""

        def run(own, found):
            return function(own.column("block")[0].as_py(), own.column("body")[0].as_buffer(), found)

        return blocks.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)

    def squares(part: int) -> DataFrame:
        def send(batches):
            for batch in batches:
                for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                    terms = B.read_terms(body.as_buffer(), group, slices, part, 2)
                    yield from B.send(block, terms, terms.df(), buckets).to_batches()

        def weigh(block, body, found):
            return B.lengths(block, B.read_terms(body, group, slices, part), found, buckets)

        totals = blocks.mapInArrow(send, B.SENT_SCHEMA).groupBy("bucket").applyInArrow(B.total_rows, B.GIVEN_SCHEMA)
        return with_blocks(totals, weigh, B.LENGTH_SCHEMA)

    lengths = [written(squares(part), "lengths", "zstd") for part in range(slices)]
    every = reduce(DataFrame.unionByName, [rows.withColumn("part", F.lit(i)) for i, rows in enumerate(lengths)])

    def sums(part: int) -> DataFrame:
        def send(block, body, found):
            terms = B.read_terms(body, group, slices, part, 2)
            share, split = B.shares(terms, found.column("squares"), found.column("df").drop_null())
            return B.send(block, terms, share, buckets, split)

        found = every.withColumn("df", F.when(F.col("part") == part, F.col("df")))
        return with_blocks(found, send, B.SENT_SCHEMA).groupBy("bucket").applyInArrow(B.total_scores, B.GIVEN_SCHEMA)

    scores = [sums(part) for part in range(slices)]
    scores = scores if slices == 1 else [written(rows, "scores", "zstd") for rows in scores]
    given = reduce(DataFrame.unionByName, [rows.withColumn("part", F.lit(i)) for i, rows in enumerate(scores)])

    def tell(block, body, found):
        return B.scored(body, group, found, slices, buckets, best)

    schema = StructType([*plain.select(*group).schema, StructField("term", StringType()), StructField("score", DoubleType())])
    return with_blocks(every.unionByName(given, allowMissingColumns=True), tell, schema)


def top_terms(scores: DataFrame, group: Sequence[str], k: int = params.KEYWORDS_PER_CLUSTER) -> DataFrame:
    """The k best terms of each group with a positive score; equal scores go by term.

    Scores are compared by nine significant digits, so that sums in another order rank alike and small scores still
    differ. The limit is applied on the map side too.
    """
    positive = scores.filter(F.col("score") > 0).withColumn("__size", F.floor(F.log10("score")))
    digits = F.round(F.col("score") * F.pow(F.lit(10.0), 8 - F.col("__size")))
    order = Window.partitionBy(*group).orderBy(F.desc("__size"), F.desc("__digits"), "term")
    ranked = positive.withColumn("__digits", digits).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).drop("__size", "__digits")


def cluster_keywords(
    texts: DataFrame,
    group: Sequence[str],
    key: str,
    text: str = "text",
    n: str = "n",
    k: int = params.KEYWORDS_PER_CLUSTER,
) -> DataFrame:
    """A label for each group: its best terms, or its first two texts where no text has a term."""
    group = list(group)
    best = (
        top_terms(term_scores(texts, group, key, text, n, k), group, k)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("ranked"))  # at most k entries
        .select(*group, F.array_join(F.col("ranked.term"), ", ").alias("keywords"))
    )
    # A group without any term has only texts without a term; of those the first two are kept.
    wordless = texts.filter(~has_token(text))
    first_two = Window.partitionBy(*group).orderBy(text, key)
    fallback = (
        wordless.withColumn("rank", F.row_number().over(first_two))
        .filter(F.col("rank") <= 2)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("line")))).alias("ranked"))
        .select(*group, F.array_join(F.col("ranked.line"), " | ").alias("lines"))
    )
    return best.join(fallback, group, "full").select(*group, F.coalesce("keywords", "lines").alias("label"))


def label_clusters(ids: DataFrame, labels: DataFrame, group: Sequence[str]) -> DataFrame:
    """A label for every cluster id; a cluster nothing fell into is named as empty."""
    return ids.join(labels, list(group), "left").withColumn(
        "label", F.coalesce("label", F.lit(params.EMPTY_CLUSTER_LABEL))
    )


def unpivot_levels(df: DataFrame, tabs: Sequence[str]) -> DataFrame:
    """(tab, cluster_id, semantic_group, mood) rows of an enriched ticket table; no id where the table has none."""

    def cluster(tab: str):
        name = f"{tab}{params.CLUSTER_SUFFIX}"
        return F.col(f"`{name}`").cast("int") if name in df.columns else F.lit(None).cast("int")

    parts = [
        F.struct(
            F.lit(tab).alias("tab"),
            cluster(tab).alias("cluster_id"),
            F.col(f"{tab}_GROUP").alias("semantic_group"),
            F.col(f"{tab}_SENT_LABEL").alias("mood"),
        )
        for tab in tabs
        if f"{tab}_GROUP" in df.columns and f"{tab}_SENT_LABEL" in df.columns
    ]
    return df.select(F.inline(F.array(*parts)))


def cluster_statistics(df: DataFrame, tabs: Sequence[str] = tuple(params.CLUSTERS_PER_TAB)) -> DataFrame:
    """Per level and cluster: texts in it, keywords, dominant mood; and the level's texts and clusters in all.

    Clusters are told apart by id, so two of one label stay two; tables without ids by their label.
    """
    per_mood = unpivot_levels(df, tabs).filter(F.col("semantic_group").isNotNull())
    per_mood = per_mood.groupBy("tab", "cluster_id", "semantic_group", "mood").agg(F.count("*").alias("rows"))
    per_cluster = per_mood.groupBy("tab", "cluster_id", "semantic_group").agg(
        F.sum("rows").alias("texts"),
        F.min(F.struct(-F.col("rows"), F.col("mood"))).alias("top"),
    )
    level = Window.partitionBy("tab")  # over clusters, of which a level has k
    return per_cluster.select(
        "tab",
        "cluster_id",
        "semantic_group",
        "texts",
        F.split("semantic_group", ", ").alias("keywords"),
        F.col("top.mood").alias("dominant_sentiment"),
        F.sum("texts").over(level).alias("tab_texts"),
        F.count("*").over(level).alias("tab_clusters"),
    )
