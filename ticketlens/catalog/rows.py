"""Queries: row features, joins and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params, schemas
from ticketlens.catalog import oracle_parts as P
from ticketlens.catalog.registry import query
from ticketlens.catalog.tables import rounded
from ticketlens.functions.text import feature_kind, label_sentiment, prepare_text
from ticketlens.operators import features as B
from ticketlens.operators import sketches, training
from ticketlens.operators.joins import attach_cluster_label, lookup_join
from ticketlens.operators.prepare import drop_leaks
from ticketlens.runtime import pinned, scratch_path
from ticketlens.streaming import scoring

_ALL = X.oracle_views


def features(spark, sf_dir):
    return B.build_features(X.tickets_semantic(spark, sf_dir))


def _only(names):
    def run(spark, sf_dir):
        df = features(spark, sf_dir).select("PROTOCOLO", *names)
        return rounded(df, *[n for n in names if n in P.ROUNDED])

    return run


_FEATURE_QUERIES = {
    "P7_critical_cluster_indicators": list(P.COUNTS),
    "P8_sentiment_indicators": list(P.PROPS),
    "P9_sentiment_scores": list(P.SCORES),
    "P10_escalation_n1_to_n3": ["escalation_n1_to_n3"],
    "P11_escalation_n2_to_n3": ["escalation_n2_to_n3"],
    "P12_degradacao_continua": ["degradacao_continua"],
    "P13_flag_problema_tecnico_grave": ["flag_problema_tecnico_grave"],
    "P14_flag_teve_cobranca": ["flag_teve_cobranca"],
    "P15_flag_mencionou_cancelamento": ["flag_mencionou_cancelamento"],
    "P16_flag_bloqueado": ["flag_bloqueado"],
    "P17_flag_insatisfacao_n3": ["flag_insatisfacao_n3"],
    "A8_row_mean_min_max": ["sent_score_mean", "sent_score_min", "sent_score_max"],
    "A9_row_sample_std": ["sent_score_std"],
    "A10_row_mood_counts": ["count_insatisfacao_total", "count_positivo_total"],
    "M12_all_features": list(P.FEATURES),
}
for _key, _names in _FEATURE_QUERIES.items():
    query(_key, P.row_features({n: P.FEATURES[n] for n in _names}))(_only(_names))


@query(
    "M13_features_of_all_splits",
    f"""{P.feature_view('split_semantic')} SELECT split, count(*) AS rows,
  {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in P.INDICATORS)}, round(avg(sent_score_mean), 6) AS mean_score
  FROM tickets_features GROUP BY split""",
)
def features_of_all_splits(spark, sf_dir):
    df = B.build_features(X.split_semantic(spark, sf_dir))
    return df.groupBy("split").agg(
        F.count("*").alias("rows"),
        *[F.sum(n).alias(n) for n in P.INDICATORS],
        # each row's mean as the feature table shows it
        F.round(F.avg(F.round("sent_score_mean", 6)), 6).alias("mean_score"),
    )


@query(
    "P18_label_sentiment",
    f"""{_ALL('tickets_semantic')} SELECT PROTOCOLO, CASE WHEN TAB_N1_SENT_SCORE <= -0.5 THEN 'insatisfacao' WHEN TAB_N1_SENT_SCORE >= 0.5
  THEN 'positivo' ELSE 'neutro' END AS mood, CASE WHEN TAB_N2_SENT_SCORE <= -0.25 THEN 'insatisfacao' WHEN TAB_N2_SENT_SCORE >= 0.75
  THEN 'positivo' ELSE 'neutro' END AS mood_other_bounds FROM tickets_semantic""",
)
def sentiment_labels(spark, sf_dir):
    return X.tickets_semantic(spark, sf_dir).select(
        "PROTOCOLO",
        label_sentiment("TAB_N1_SENT_SCORE").alias("mood"),
        label_sentiment("TAB_N2_SENT_SCORE", (-0.25, 0.75)).alias("mood_other_bounds"),
    )


@query(
    "P21_missing_columns_skipped",
    P.row_features(
        {
            k: v
            for k, v in {**P.FEATURES, "flag_teve_cobranca": P._has("concat_ws(chr(10), TAB_N1_GROUP, TAB_N3_GROUP)", "cobrança|inadimplencia"),
                         "count_insatisfacao_total": "(CASE WHEN TAB_N1_SENT_LABEL = 'insatisfacao' THEN 1 ELSE 0 END) + "
                         "(CASE WHEN TAB_N3_SENT_LABEL = 'insatisfacao' THEN 1 ELSE 0 END)",
                         "count_positivo_total": "(CASE WHEN TAB_N1_SENT_LABEL = 'positivo' THEN 1 ELSE 0 END) + "
                         "(CASE WHEN TAB_N3_SENT_LABEL = 'positivo' THEN 1 ELSE 0 END)"}.items()
            if "tab_n2" not in k and k not in ("escalation_n2_to_n3", "degradacao_continua")
        }
    ),
)
def missing_columns_skipped(spark, sf_dir):
    df = X.tickets_semantic(spark, sf_dir).drop("TAB_N2_GROUP", "TAB_N2_SENT_LABEL")
    return rounded(B.build_features(df).select("PROTOCOLO", *B.feature_names(df)), *P.ROUNDED)


@query(
    "F4_regex_contains",
    f"""{_ALL('tickets')} SELECT PROTOCOLO, coalesce(regexp_matches(TAB_N2, 'cobrança|inadimpl', 'i'), false) AS billing,
  coalesce(regexp_matches(TAB_N3, 'COBRANÇA|DÉBITOS', 'i'), false) AS debts FROM tickets""",
)
def regex_contains(spark, sf_dir):
    no = F.lit(False)
    return X.tickets(spark, sf_dir).select(
        "PROTOCOLO",
        F.coalesce(B.mentions("TAB_N2", "cobrança|inadimpl"), no).alias("billing"),
        F.coalesce(B.mentions("TAB_N3", "COBRANÇA|DÉBITOS"), no).alias("debts"),
    )


# ------------------------------------------------------------------ joins
_DICTIONARY = f"""{_ALL('tickets')}, dictionary AS (SELECT trim(coalesce(TAB_N2, 'nan')) AS text, count(*) AS n, max(TICKET_MEDIO) AS top_value
  FROM tickets GROUP BY 1)
SELECT PROTOCOLO, TAB_N2, n AS text_rows, top_value FROM tickets JOIN dictionary ON text = trim(coalesce(TAB_N2, 'nan'))"""


def _attach(spark, sf_dir, **limits):
    keyed = X.tickets(spark, sf_dir).select("PROTOCOLO", "TAB_N2", "TICKET_MEDIO", prepare_text("TAB_N2").alias("text"))
    dictionary = pinned(keyed.groupBy("text").agg(F.count("*").alias("n"), F.max("TICKET_MEDIO").alias("top_value")))
    lookup = dictionary.withColumn("text_rows", F.col("n"))
    joined = lookup_join(keyed.drop("TICKET_MEDIO"), lookup, ["text"], "n", ["PROTOCOLO"], **limits)
    return joined.select("PROTOCOLO", "TAB_N2", "text_rows", "top_value")


@query("J1_attach_by_text", _DICTIONARY)
def attach_by_text(spark, sf_dir):
    return _attach(spark, sf_dir)


@query("J1_attach_by_text_salted", _DICTIONARY)
def attach_by_text_salted(spark, sf_dir):
    """The same through the path for dictionaries too large to broadcast."""
    return _attach(spark, sf_dir, broadcast_rows=0)


@query(
    "J2_cluster_label_lookup",
    f"""{_ALL('tickets_semantic')}, labels AS (SELECT PROTOCOLO % 10 AS cluster_id, min(TAB_N3_GROUP) AS label FROM tickets_semantic
  WHERE TAB_N3_GROUP IS NOT NULL GROUP BY 1)
SELECT PROTOCOLO, coalesce(label, 'cluster_' || CAST(PROTOCOLO % 12 AS string)) AS semantic_group
FROM tickets_semantic LEFT JOIN labels ON cluster_id = PROTOCOLO % 12""",
)
def cluster_label_lookup(spark, sf_dir):
    df = X.tickets_semantic(spark, sf_dir)
    labels = (
        df.filter(F.col("TAB_N3_GROUP").isNotNull())
        .groupBy((F.col("PROTOCOLO") % 10).alias("cluster_id"))
        .agg(F.min("TAB_N3_GROUP").alias("label"))
    )
    clustered = df.select("PROTOCOLO", (F.col("PROTOCOLO") % 12).alias("cluster_id"))
    return attach_cluster_label(clustered, labels).select("PROTOCOLO", "semantic_group")


@query(
    "J3_append_feature_blocks",
    f"""{_ALL('tickets_semantic')} SELECT *, {P.select_list(P.FEATURES)}
  FROM tickets_semantic""",
)
def append_feature_blocks(spark, sf_dir):
    return rounded(features(spark, sf_dir), *P.ROUNDED)


@query(
    "U1_first_of_equal_names",
    f"""{_ALL('tickets_semantic')} SELECT PROTOCOLO, CAST(PROTOCOLO % 3 AS INTEGER) AS flag_bloqueado, {P.FLAGS['flag_teve_cobranca']} AS
  flag_teve_cobranca FROM tickets_semantic""",
)
def first_of_equal_names(spark, sf_dir):
    df = X.tickets_semantic(spark, sf_dir).withColumn("flag_bloqueado", (F.col("PROTOCOLO") % 3).cast("int"))
    later = lambda columns: {"flag_teve_cobranca": F.lit(9)}
    return B.build_features(df, (*B.DEFAULT_BLOCKS, later)).select("PROTOCOLO", "flag_bloqueado", "flag_teve_cobranca")


# ------------------------------------------------------------------ extension points
@query(
    "X1_own_feature_block",
    P.row_features({"flag_expensive": "CASE WHEN TICKET_MEDIO > 100 THEN 1 ELSE 0 END", "flag_bloqueado": P.FLAGS["flag_bloqueado"]}),
)
def own_feature_block(spark, sf_dir):
    def expensive(columns):
        known = "TICKET_MEDIO" in columns
        return {"flag_expensive": F.coalesce(F.col("TICKET_MEDIO") > 100, F.lit(False)).cast("int")} if known else {}

    df = B.build_features(X.tickets_semantic(spark, sf_dir), (*B.DEFAULT_BLOCKS, expensive))
    return df.select("PROTOCOLO", "flag_expensive", "flag_bloqueado")


@query(
    "X2_own_critical_clusters",
    P.row_features({"count_tab_n2_growth": "CASE WHEN TAB_N2_GROUP IN ('upgrade', 'COBRANÇA') THEN 1 ELSE 0 END"}),
)
def own_critical_clusters(spark, sf_dir):
    block = B.critical_cluster_block([("TAB_N2", "growth", "upgrade"), ("TAB_N2", "growth", "COBRANÇA")])
    return B.build_features(X.tickets_semantic(spark, sf_dir), (block,)).select("PROTOCOLO", "count_tab_n2_growth")


# ------------------------------------------------------------------ feature matrix
@query(
    "P3_drop_non_model_columns",
    f"{_ALL('tickets')} SELECT ID_CLIENTE, CODIGO, PROTOCOLO, NUMERO_OS, ULTIMO_CANCELAMENTO, TICKET_MEDIO, IDADE_APROX, MESES FROM tickets",
)
def drop_non_model_columns(spark, sf_dir):
    return training.drop_non_model(X.tickets(spark, sf_dir))


_NUMBERS = "ID_CLIENTE, PROTOCOLO, TICKET_MEDIO, IDADE_APROX, MESES, TAB_N1_SENT_SCORE, TAB_N2_SENT_SCORE, TAB_N3_SENT_SCORE"


@query("P4_numeric_columns", f"{_ALL('tickets_semantic')} SELECT {_NUMBERS} FROM tickets_semantic")
def numeric_columns(spark, sf_dir):
    df = training.drop_non_model(X.tickets_semantic(spark, sf_dir))
    return df.select(*training.numeric_columns(df))


@query(
    "P5_null_to_zero",
    f"""{_ALL('tickets_semantic')} SELECT PROTOCOLO, {', '.join(f'coalesce(TAB_N{i}_SENT_SCORE, 0.0) AS TAB_N{i}_SENT_SCORE' for i in (1, 2, 3))}
  FROM tickets_semantic""",
)
def null_to_zero(spark, sf_dir):
    names = ["PROTOCOLO", "TAB_N1_SENT_SCORE", "TAB_N2_SENT_SCORE", "TAB_N3_SENT_SCORE"]
    return training.feature_matrix(X.tickets_semantic(spark, sf_dir), carry=()).select(*names)


@query(
    "P6_label_to_int",
    f"""{_ALL('tickets_semantic')} SELECT PROTOCOLO, CAST(coalesce(CASE WHEN PROTOCOLO % 29 = 0 THEN NULL ELSE TARGET END, 0) AS INTEGER) AS label
  FROM tickets_semantic""",
)
def label_to_int(spark, sf_dir):
    gaps = F.when(F.col("PROTOCOLO") % 29 != 0, F.col("TARGET").cast("double"))
    return training.with_label(X.tickets_semantic(spark, sf_dir).withColumn("TARGET", gaps)).select("PROTOCOLO", "label")


def _matrix(spark, sf_dir):
    enriched = B.build_features(X.split_semantic(spark, sf_dir))
    return training.feature_matrix(drop_leaks(enriched))


@query(
    "M14_feature_matrix",
    f"""{P.feature_view('split_semantic')} SELECT split, TARGET AS label, {', '.join(f'coalesce({c}, 0) AS {c}' for c in P.INPUTS)}
  FROM tickets_features""",
)
def feature_matrix(spark, sf_dir):
    return rounded(_matrix(spark, sf_dir), *P.ROUNDED)


# ------------------------------------------------------------------ importances, from a stand-in derived from the data
def importances(spark, sf_dir):
    """The share of each model input in all non-zero values."""
    matrix = _matrix(spark, sf_dir)
    names = training.input_names(matrix)
    wide = matrix.agg(*[F.count_if(F.abs(n) > 1e-7).alias(n) for n in names])
    hits = wide.unpivot([], names, "feature", "hits")
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return hits.select("feature", (F.col("hits") / wide.select(total).scalar()).alias("importance"))


# fixed values: kinds of model inputs by parts of their names
_KIND = """CASE WHEN contains(feature, 'count_') THEN 'Contador' WHEN contains(feature, 'prop_') OR contains(feature, 'sent_score_')
  THEN 'Sentimento' WHEN contains(feature, 'escalation_') OR contains(feature, 'degradacao_') THEN 'Escalation'
  WHEN contains(feature, 'flag_') THEN 'Flag Crítica' WHEN contains(feature, '_mean') OR contains(feature, '_std')
  OR contains(feature, '_min') OR contains(feature, '_max') THEN 'Agregação' ELSE 'Original' END"""
_RANKED = "SELECT feature, round(importance, 9) AS importance, row_number() OVER (ORDER BY importance DESC, feature)"


@query("P20_feature_kind", f"{P.importances_view()} SELECT feature, {_KIND} AS kind FROM importances")
def feature_kinds(spark, sf_dir):
    return importances(spark, sf_dir).select("feature", feature_kind("feature").alias("kind"))


@query("O2_top_importances", f"{P.importances_view()} {_RANKED} AS rank FROM importances QUALIFY rank <= 15")
def top_importances(spark, sf_dir):
    return rounded(training.rank_importances(importances(spark, sf_dir), 15), "importance", digits=9)


@query(
    "O3_ten_importances",
    f"{P.importances_view()} SELECT feature, round(importance, 9) AS importance FROM importances ORDER BY importance DESC, feature LIMIT 10",
)
def ten_importances(spark, sf_dir):
    return rounded(training.top_importances(importances(spark, sf_dir), 10), "importance", digits=9)


@query("R4_importance_report", f"{P.importances_view()} {_RANKED} AS rank, {_KIND} AS kind FROM importances")
def importance_report(spark, sf_dir):
    return rounded(training.explain_importances(importances(spark, sf_dir)), "importance", digits=9)


# ------------------------------------------------------------------ streaming
_DRIFTING = ["TICKET_MEDIO", "IDADE_APROX", "MESES"]
_RATIO, _LEAST = "(1.01::DOUBLE / 0.99)", "1e-9::DOUBLE"
_BIN = f"""CASE WHEN abs(v) < {_LEAST} THEN 0 WHEN v < 0 THEN -1 - CAST(floor(ln(abs(v) / {_LEAST}) / ln({_RATIO})) AS INTEGER)
  ELSE 1 + CAST(floor(ln(abs(v) / {_LEAST}) / ln({_RATIO})) AS INTEGER) END"""


def _sketched(closed_only: bool) -> str:
    """WITH clause ending in ``sk``: bins per day and feature."""
    closed = "WHERE date_trunc('day', DATA_REGISTRO) + INTERVAL 2 DAY <= (SELECT max(DATA_REGISTRO) FROM tickets)" if closed_only else ""
    values = " UNION ALL ".join(f"SELECT date_trunc('day', DATA_REGISTRO) AS period, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM tickets {closed}" for f in _DRIFTING)
    return f"{X.oracle_views('tickets')}, vals AS ({values}), sk AS (SELECT period, feature, {_BIN} AS bin, count(*) AS rows FROM vals GROUP BY ALL)"


@query("D6_stream_sketches", f"{_sketched(True)} SELECT * FROM sk")
def stream_sketches(spark, sf_dir):
    """Sketches per day from a stream; days less than a day before the latest ticket are still open."""
    output = scratch_path(spark, "sketches")
    stream = scoring.ticket_stream(spark, sf_dir, schemas.EVENTS, "events.parquet")
    run = scoring.run_available(stream, output, scratch_path(spark, "progress"), lambda df: sketches.sketch_stream(X.as_tickets(df), _DRIFTING, "DATA_REGISTRO"))
    assert run.exception() is None
    return spark.read.parquet(output)


@query(
    "D6_drift_of_days",
    f"""{_sketched(False)}, base AS (SELECT feature, bin, sum(rows) AS rows FROM sk WHERE period < TIMESTAMP '2024-01-08' GROUP BY ALL),
up AS (SELECT *, sum(rows) OVER (PARTITION BY feature ORDER BY bin) AS upto, sum(rows) OVER (PARTITION BY feature) AS total FROM base),
ends AS (SELECT DISTINCT feature, bin AS e FROM up, range(1, 10) r(k) WHERE upto * 10 >= k * total AND (upto - rows) * 10 < k * total),
cuts AS (SELECT feature, list(e ORDER BY e) AS ends FROM ends GROUP BY feature),
b AS (SELECT feature, len(list_filter(ends, lambda x: x < bin)) AS g, sum(rows) AS n FROM base JOIN cuts USING (feature) GROUP BY ALL),
p AS (SELECT period, feature, len(list_filter(ends, lambda x: x < bin)) AS g, sum(rows) AS n FROM sk JOIN cuts USING (feature) GROUP BY ALL),
gs AS (SELECT feature, unnest(range(len(ends) + 1)) AS g FROM cuts),
bs AS (SELECT feature, g, greatest(CAST(coalesce(n, 0) AS DOUBLE) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY feature) AS DOUBLE), 0.0001) AS share FROM gs LEFT JOIN b USING (feature, g)),
days AS (SELECT DISTINCT period, feature FROM sk),
ps AS (SELECT period, feature, g, greatest(CAST(coalesce(n, 0) AS DOUBLE) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY period, feature) AS DOUBLE), 0.0001) AS share
  FROM days JOIN gs USING (feature) LEFT JOIN p USING (period, feature, g)),
x AS (SELECT period, feature, round(sum((ps.share - bs.share) * ln(ps.share / bs.share)), 6) AS psi FROM ps JOIN bs USING (feature, g) GROUP BY ALL)
SELECT period, feature, CAST(sum(rows) AS BIGINT) AS rows, 0::BIGINT AS missing, any_value(psi) AS psi FROM sk JOIN x USING (period, feature) GROUP BY ALL""",
)
def drift_of_days(spark, sf_dir):
    """Each day against the first week, from the sketches alone."""
    table = pinned(sketches.sketch(X.tickets(spark, sf_dir), _DRIFTING, "DATA_REGISTRO"))
    base = table.filter(F.col("period") < F.lit("2024-01-08").cast("timestamp_ntz"))
    return rounded(sketches.drift_of_periods(table, base), "psi")


@query("ST1_stream_features", P.row_features(P.FEATURES))
def stream_features(spark, sf_dir):
    """The whole event file as a stream: same functions, same rows."""
    names = list(P.FEATURES)
    output = scratch_path(spark, "stream")
    stream = scoring.ticket_stream(spark, sf_dir, schemas.EVENTS, "events.parquet")
    scoring.run_available(
        stream,
        output,
        scratch_path(spark, "progress"),
        lambda df: B.build_features(X.as_semantic(X.as_tickets(df))).select(params.TICKET, *names),
    )
    return rounded(spark.read.parquet(output), *P.ROUNDED)
