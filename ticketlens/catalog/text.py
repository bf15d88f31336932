"""Queries: text functions, cluster labels and embeddings, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params
from ticketlens.catalog.oracle_parts import TOKENS, terms_view
from ticketlens.catalog.registry import query
from ticketlens.catalog.tables import document_groups, rounded
from ticketlens.functions import text as TX
from ticketlens.functions.vectors import nearest_centroid, project_score
from ticketlens.operators import clusters
from ticketlens.operators import semantics as S
from ticketlens.operators.encoders import EMBEDDING, TableEncoder
from ticketlens.runtime import evened, local_table, pinned, spread
from ticketlens.schemas import table_schema


def _docs(spark, sf_dir):
    return spread(X.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


_FOLDED = (
    r"regexp_replace(regexp_replace(strip_accents(upper(replace(coalesce(text, ''), 'ß', 'ss'))), '[^\x00-\x7F]', '', 'g'), "
    r"'^[\t-\r\x1c-\x20]+|[\t-\r\x1c-\x20]+$', '', 'g')"
)


@query("F1_normalize_text", f"SELECT doc_id, md5({_FOLDED}) AS folded, length({_FOLDED}) AS chars FROM documents")
def normalize_text(spark, sf_dir):
    folded = _docs(spark, sf_dir).select("doc_id", TX.normalize_text("text").alias("folded"))
    return folded.select("doc_id", F.md5("folded").alias("folded"), F.length("folded").cast("long").alias("chars"))


_UNSTRIPPED = r"regexp_replace(strip_accents(upper(replace(coalesce(text, ''), 'ß', 'ss'))), '[^\x00-\x7F]', '', 'g')"


@query(
    "F1_normalize_text_full",
    rf"""SELECT doc_id, md5(t) AS folded, length(t) AS chars
FROM (SELECT doc_id, regexp_replace('12 DOSE A A DZ FIM TM kg No 3 ' || upper(lang) || {_UNSTRIPPED}, '[\t-\r\x1c-\x20]+$', '') AS t FROM documents)""",
)
def normalize_text_full(spark, sf_dir):
    """Characters that stand for several, and other scripts, before every whole text."""
    docs = spread(X.documents(spark, sf_dir).select("doc_id", "lang", "text"), "doc_id")
    odd = F.concat(F.lit(" ½ dose ạ Ạ Ǆ ﬁm ™ ㎏ № ３ "), "lang", F.lit("☃"), F.coalesce("text", F.lit("")))
    folded = docs.select("doc_id", TX.normalize_text(odd).alias("folded"))
    return folded.select("doc_id", F.md5("folded").alias("folded"), F.length("folded").cast("long").alias("chars"))


_SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "F2_prepare_text",
    f"""SELECT doc_id, md5(regexp_replace(t, '^{_SPACES}|{_SPACES}$', '', 'g')) AS prepared, length(t) AS chars
FROM (SELECT doc_id, coalesce(chr(9) || '  ' || text || chr(160) || chr(10), '') AS t FROM documents)""",
)
def prepare_text(spark, sf_dir):
    docs = X.documents(spark, sf_dir).select("doc_id", "text")
    padded = F.concat(F.lit("\t  "), "text", F.lit("\u00a0\n"))
    return docs.select("doc_id", padded.alias("t")).select(
        "doc_id",
        F.md5(TX.prepare_text("t", null_text="")).alias("prepared"),
        F.length(F.coalesce("t", F.lit(""))).cast("long").alias("chars"),
    )


@query(
    "F3_null_text_to_literal",
    f"{X.oracle_views('tickets')} SELECT PROTOCOLO, coalesce(TAB_N2, 'nan') AS text FROM tickets",
)
def null_text(spark, sf_dir):
    return X.tickets(spark, sf_dir).select("PROTOCOLO", TX.prepare_text("TAB_N2").alias("text"))


@query(
    "F5_tokens",
    f"""SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS w FROM documents)""",
)
def tokens(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", TX.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


_GRAMS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"


@query(
    "F6_one_and_two_grams",
    f"""SELECT doc_id, len(g) AS grams, md5(array_to_string(g, '|')) AS digest, len(list_distinct(g)) AS distinct_grams
FROM (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {TOKENS} AS w FROM documents))""",
)
def grams(spark, sf_dir):
    words = _docs(spark, sf_dir).select("doc_id", TX.tokens("text").alias("w"))
    pairs = words.select("doc_id", TX.one_and_two_grams("w").alias("g"))
    counted = pairs.select("doc_id", "g", TX.term_counts("g").alias("counts"))
    return counted.select(
        "doc_id",
        F.size("g").cast("long").alias("grams"),
        F.md5(F.array_join("g", "|")).alias("digest"),
        F.size("counts").cast("long").alias("distinct_grams"),
    )


# ------------------------------------------------------------------ cluster labels
@query("A11_mean_tfidf", f"{terms_view()} SELECT cluster, term, round(score, 9) AS score FROM term_scores")
def mean_tfidf(spark, sf_dir):
    return rounded(clusters.term_scores(document_groups(spark, sf_dir), ["cluster"], "doc_id"), "score", digits=9)


@query("O4_top_terms", f"{terms_view()} SELECT cluster, rank, term, score FROM top_terms WHERE rank <= 4 AND score > 0")
def top_terms(spark, sf_dir):
    scores = clusters.term_scores(document_groups(spark, sf_dir), ["cluster"], "doc_id", best=params.KEYWORDS_PER_CLUSTER)
    return clusters.top_terms(scores, ["cluster"]).select("cluster", "rank", "term", F.round("score", 9).alias("score"))


_LABELS = """labels AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS label FROM top_terms WHERE rank <= 4 AND score > 0
  GROUP BY cluster)"""


@query("M6_cluster_keywords", f"{terms_view()}, {_LABELS} SELECT cluster, label FROM labels")
def cluster_keywords(spark, sf_dir):
    return clusters.cluster_keywords(document_groups(spark, sf_dir), ["cluster"], "doc_id")


_TEXTS = f"""{X.oracle_views('tickets')}, long AS (SELECT TAB_N3 AS text, PROTOCOLO % 4 AS cluster FROM tickets
  UNION ALL SELECT CANAL, PROTOCOLO % 4 FROM tickets UNION ALL SELECT TAB_N1, PROTOCOLO % 4 FROM tickets
  UNION ALL SELECT 'para que ' || CAST(PROTOCOLO % 7 AS string), 4 + PROTOCOLO % 2 FROM tickets),
words AS (SELECT cluster, text, count(*) AS n, {TOKENS} AS w FROM long GROUP BY cluster, text),
grams AS (SELECT cluster, text, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT cluster, text, n, term, count(*) AS tf FROM grams GROUP BY ALL),
corpus AS (SELECT cluster, sum(n) AS rows FROM words GROUP BY cluster),
df AS (SELECT cluster, term, sum(n) AS df FROM tf GROUP BY ALL),
weighed AS (SELECT cluster, text, n, rows, term, tf * (ln(CAST(1 + rows AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1) AS w
  FROM tf JOIN df USING (cluster, term) JOIN corpus USING (cluster)),
norms AS (SELECT cluster, text, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
scores AS (SELECT cluster, term, round(sum(n * w / norm) / CAST(rows AS DOUBLE), 9) AS score FROM weighed JOIN norms USING (cluster, text)
  GROUP BY cluster, term, rows),
best AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM scores WHERE score > 0),
labels AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS label FROM best WHERE rank <= 4 GROUP BY cluster),
lines AS (SELECT cluster, text, row_number() OVER (PARTITION BY cluster ORDER BY text) AS rank FROM words WHERE len(w) = 0),
fallback AS (SELECT cluster, string_agg(text, ' | ' ORDER BY rank) AS label FROM lines WHERE rank <= 2 GROUP BY cluster),
ids AS (SELECT DISTINCT PROTOCOLO % 7 AS cluster FROM tickets)
SELECT cluster, coalesce(l.label, f.label, 'cluster_vazio') AS label FROM ids LEFT JOIN labels l USING (cluster) LEFT JOIN fallback f USING (cluster)"""


@query("F7_join_keywords", _TEXTS)
def join_keywords(spark, sf_dir):
    """Weighted category texts; two clusters of stopwords only, and one without texts."""
    tickets = X.tickets(spark, sf_dir).select("PROTOCOLO", "TAB_N1", "TAB_N3", "CANAL")
    four = (F.col("PROTOCOLO") % 4).alias("cluster")
    stopwords = F.concat(F.lit("para que "), (F.col("PROTOCOLO") % 7).cast("string")).alias("text")
    long = tickets.select(F.explode(F.array("TAB_N3", "CANAL", "TAB_N1")).alias("text"), four).unionByName(
        tickets.select(stopwords, (4 + F.col("PROTOCOLO") % 2).alias("cluster"))
    )
    texts = long.groupBy("cluster", "text").agg(F.count("*").alias("n"))
    ids = tickets.select((F.col("PROTOCOLO") % 7).alias("cluster")).distinct()
    labels = clusters.cluster_keywords(texts, ["cluster"], "text")
    return clusters.label_clusters(ids, labels, ["cluster"])


# ------------------------------------------------------------------ embeddings
_LONG = "long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query(
    "M4_nearest_centroid",
    f"""WITH {_LONG}, c AS (SELECT label AS cluster_id, i, avg(v) AS m FROM long GROUP BY ALL),
d AS (SELECT vec_id, cluster_id, sum((v - m) * (v - m)) AS distance FROM long JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, arg_min(cluster_id, distance) AS cluster_id, round(min(distance), 6) AS distance FROM d GROUP BY vec_id""",
)
def nearest(spark, sf_dir):
    df = X.embeddings(spark, sf_dir)
    best = nearest_centroid(EMBEDDING, S.group_centroids(df, "label"))
    return df.select("vec_id", best.alias("best")).select(
        "vec_id", "best.cluster_id", F.round("best.distance", 6).alias("distance")
    )


@query(
    "F8_sentiment_projection",
    f"""WITH {_LONG}, w AS (SELECT i, avg(v) AS m FROM long GROUP BY i)
SELECT vec_id, round(sum(v * m), 9) AS score, 0.0::DOUBLE AS without_seeds FROM long JOIN w USING (i) GROUP BY vec_id""",
)
def sentiment_projection(spark, sf_dir):
    df = X.embeddings(spark, sf_dir)
    weights = S.group_centroids(df.withColumn("everything", F.lit(0)), "everything")[0][1]
    return df.select(
        "vec_id",
        F.round(project_score(EMBEDDING, weights), 9).alias("score"),
        project_score(EMBEDDING, None).alias("without_seeds"),
    )


@query(
    "M5_sentiment_direction",
    "SELECT label, count(*) AS rows, round((label - 4.5) / 5, 6) AS mean_score FROM embeddings GROUP BY label",
)
def sentiment_direction(spark, sf_dir):
    """Direction fitted on the class means; linear, so the mean score of a class is the score its seed has."""
    df = X.embeddings(spark, sf_dir)
    seeds = [(list(mean), (label - 4.5) / 5) for label, mean in S.group_centroids(df, "label")]
    weights = S.seed_direction(spark.createDataFrame(seeds, "embedding array<double>, score double"))
    scored = df.select("label", project_score(EMBEDDING, weights).alias("score"))
    return scored.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.avg("score"), 6).alias("mean_score"))


def _precomputed(spark, sf_dir):
    table = X.embeddings(spark, sf_dir).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), EMBEDDING)
    return TableEncoder(table)


#: Each level's text is made of another number of the ticket.
_CODES = {"TAB_N1": "CODIGO", "TAB_N2": "CODIGO * 7 % 997", "TAB_N3": "PROTOCOLO % 613"}


def _coded(spark, sf_dir):
    """Tickets with texts that the embedding table partly knows, in all levels."""
    texts = [F.concat(F.lit("v"), F.expr(code).cast("string")).alias(tab) for tab, code in _CODES.items()]
    return X.tickets(spark, sf_dir).select("PROTOCOLO", *texts)


_CODED = f"""{X.oracle_views('tickets')}, wide AS (SELECT PROTOCOLO, {', '.join(f"'v' || CAST({code} AS string) AS {tab}" for tab, code in _CODES.items())} FROM tickets),
coded AS (SELECT PROTOCOLO, TAB_N1 AS text FROM wide)"""


@query(
    "M2_precomputed_encoder",
    f"""{_CODED}, {_LONG}, norms AS (SELECT 'v' || CAST(vec_id AS string) AS text, round(sum(v * v), 6) AS square FROM long GROUP BY vec_id),
texts AS (SELECT text, count(*) AS n FROM coded GROUP BY text) SELECT text, n, square FROM texts LEFT JOIN norms USING (text)""",
)
def precomputed_encoder(spark, sf_dir):
    dictionary = S.text_dictionary(_coded(spark, sf_dir), ["TAB_N1"]).select("text", "n")
    encoded = _precomputed(spark, sf_dir).encode(dictionary, "text")
    square = F.aggregate(EMBEDDING, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return encoded.select("text", "n", F.round(square, 6).alias("square"))


_NAMES = {"TAB_N1": "grupo", "TAB_N2": "tema", "TAB_N3": "caso"}


def _given_model(spark, sf_dir):
    """Level models from given tables: class means as centroids, the mean of all as direction, some labels."""
    df = X.embeddings(spark, sf_dir)
    centroids = S.GivenCentroids(tuple(tuple(c) for _, c in S.group_centroids(df, "label")))
    weights = tuple(S.group_centroids(df.withColumn("everything", F.lit(0)), "everything")[0][1])
    encoder = _precomputed(spark, sf_dir)
    levels = {}
    for tab, name in _NAMES.items():
        labels = tuple((i, f"{name} {i}") for i in range(0, len(centroids.centroids), 2))
        levels[tab] = S.LevelModel(tab, encoder, centroids, labels, weights, (0.0, 0.02))
    return S.SemanticModel(levels)


def _given_columns(tab: str) -> str:
    return f"""wide.{tab}, CASE WHEN {tab}_m.text IS NULL THEN NULL WHEN {tab}_m.cluster_id % 2 = 0 THEN '{_NAMES[tab]} ' || CAST({tab}_m.cluster_id AS string)
  ELSE 'cluster_' || CAST({tab}_m.cluster_id AS string) END AS {tab}_GROUP, round({tab}_m.score, 9) AS {tab}_SENT_SCORE,
  CASE WHEN {tab}_m.score <= 0 THEN 'insatisfacao' WHEN {tab}_m.score >= 0.02 THEN 'positivo' ELSE 'neutro' END AS {tab}_SENT_LABEL"""


_GIVEN = f"""{_CODED}, {_LONG}, c AS (SELECT label AS cluster_id, i, avg(v) AS m FROM long GROUP BY ALL),
d AS (SELECT vec_id, cluster_id, sum((v - m) * (v - m)) AS distance FROM long JOIN c USING (i) GROUP BY ALL),
w AS (SELECT i, avg(v) AS m FROM long GROUP BY i),
s AS (SELECT vec_id, sum(v * m) AS score FROM long JOIN w USING (i) GROUP BY vec_id),
a AS (SELECT vec_id, arg_min(cluster_id, distance) AS cluster_id FROM d GROUP BY vec_id),
model AS (SELECT 'v' || CAST(vec_id AS string) AS text, cluster_id, score FROM a JOIN s USING (vec_id))
SELECT PROTOCOLO, {', '.join(map(_given_columns, _NAMES))}
FROM wide {' '.join(f'LEFT JOIN model {tab}_m ON {tab}_m.text = wide.{tab}' for tab in _NAMES)}"""


def _given_result(enriched):
    names = [c for c in enriched.columns if not c.endswith("_CLUSTER")]
    return rounded(enriched.select(*names), *[f"{tab}_SENT_SCORE" for tab in _NAMES], digits=9)


@query("M8_semantic_transform", _GIVEN)
def semantic_transform(spark, sf_dir):
    """All levels."""
    return _given_result(_given_model(spark, sf_dir).transform(_coded(spark, sf_dir), ["PROTOCOLO"]))


@query("X3_own_encoder", _GIVEN)
def own_encoder(spark, sf_dir):
    """An encoder is any object with ``encode``; the row-by-row path gives what the dictionary path gives, in all levels."""
    inner = _precomputed(spark, sf_dir)

    class Known:
        def encode(self, df, text):
            return inner.encode(df, text)

    given = _given_model(spark, sf_dir).levels
    own = {tab: S.LevelModel(tab, Known(), m.kmeans, m.labels, m.weights, m.bounds) for tab, m in given.items()}
    return _given_result(S.SemanticModel(own).transform_rows(evened(pinned(_coded(spark, sf_dir)))))


@query(
    "M11_level_parameters",
    f"""{X.oracle_views('tickets')}, long AS (SELECT 'TAB_N1' AS tab, TAB_N1 AS text FROM tickets UNION ALL
  SELECT 'TAB_N2', TAB_N2 FROM tickets UNION ALL SELECT 'TAB_N3', TAB_N3 FROM tickets),
folded AS (SELECT tab, lower(strip_accents(text)) AS seed_text, count(*) AS tickets FROM long GROUP BY ALL),
seeds AS (SELECT * FROM (VALUES {', '.join(f"('{tab}', '{seed}', {score}::DOUBLE)" for tab, seed, score in params.SENTIMENT_SEEDS)})
  t(tab, seed_text, score))
SELECT tab, CASE tab WHEN 'TAB_N1' THEN 6 WHEN 'TAB_N2' THEN 12 ELSE 18 END AS clusters, seed_text, score, coalesce(tickets, 0) AS tickets
FROM seeds LEFT JOIN folded USING (tab, seed_text)""",
)
def level_parameters(spark, sf_dir):
    """Clusters and seeds of each level, and how many tickets carry a seed as their whole text."""
    levels = S.text_levels()
    rows = [(x.tab, x.clusters, seed, score) for x in levels for seed, score in x.seeds]
    schema = table_schema("tab string, clusters int, seed_text string, score double")
    seeds = local_table(spark, rows, schema)
    dictionary = S.text_dictionary(X.tickets(spark, sf_dir), [x.tab for x in levels])
    folded = dictionary.select("tab", F.lower(TX.normalize_text("text")).alias("seed_text"), "n")
    counts = folded.groupBy("tab", "seed_text").agg(F.sum("n").alias("tickets"))
    return seeds.join(counts, ["tab", "seed_text"], "left").withColumn("tickets", F.coalesce("tickets", F.lit(0)))
