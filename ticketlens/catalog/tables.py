"""Queries: sources, sinks, preparation, splits and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import params, schemas
from ticketlens.catalog.oracle_parts import INDICATORS, INPUTS, ROUNDED, feature_view, metrics_view, terms_view
from ticketlens.catalog.registry import query
from ticketlens.operators import metrics as M
from ticketlens.operators import profile, split, temporal
from ticketlens.operators.clusters import cluster_keywords
from ticketlens.operators.features import build_features, occurrences
from ticketlens.operators.prepare import add_target, drop_leaks, prepare
from ticketlens.runtime import scratch_path, spread
from ticketlens.sources import tables as T

_ALL = X.oracle_views
_METRIC_COLUMNS = (
    "dataset, round(auc_roc, 6) AS auc_roc, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1_score, 6) AS f1_score"
)


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def metrics_at(spark, sf_dir, threshold: float = 0.6):
    return M.metrics_table(X.scored(spark, sf_dir), threshold)


def document_groups(spark, sf_dir):
    """Whole documents as texts of six given clusters."""
    docs = spread(X.documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return docs.select((F.col("doc_id") % 6).alias("cluster"), "doc_id", "text", F.lit(1).alias("n"))


# ------------------------------------------------------------------ sources and sinks
@query("S1_read_raw_tickets", f"{_ALL('tickets')} SELECT * FROM tickets")
def read_raw(spark, sf_dir):
    return X.tickets(spark, sf_dir)


@query("S2_read_by_suffix", f"{_ALL('tickets')} SELECT * FROM tickets")
def read_by_suffix(spark, sf_dir):
    path = T.write_table(X.tickets(spark, sf_dir), scratch_path(spark, "tickets.csv"))
    return T.read_table(spark, path, schema=schemas.RAW_TICKETS)


@query("S3_write_by_suffix", f"{_ALL('tickets_semantic')} SELECT * FROM tickets_semantic")
def write_by_suffix(spark, sf_dir):
    path = T.write_table(X.tickets_semantic(spark, sf_dir), scratch_path(spark, "enriched.parquet"))
    return T.read_table(spark, path)


@query("S4_write_splits", f"{_ALL('split_semantic')} SELECT PROTOCOLO, TARGET, split FROM split_semantic")
def write_splits(spark, sf_dir):
    path = T.write_splits(X.split_semantic(spark, sf_dir), scratch_path(spark, "splits"))
    return T.read_splits(spark, path).select("PROTOCOLO", "TARGET", "split")


@query(
    "S5_read_splits",
    f"{_ALL('split_semantic')} SELECT PROTOCOLO, TARGET, TAB_N3_GROUP, split FROM split_semantic WHERE split <> 'train'",
)
def read_splits(spark, sf_dir):
    path = T.write_splits(X.split_semantic(spark, sf_dir), scratch_path(spark, "splits"))
    return T.read_splits(spark, path, ["validation", "test"]).select("PROTOCOLO", "TARGET", "TAB_N3_GROUP", "split")


@query("S6_write_metrics", f"{metrics_view()} SELECT {_METRIC_COLUMNS} FROM metrics")
def write_metrics(spark, sf_dir):
    path = T.write_table(metrics_at(spark, sf_dir), scratch_path(spark, "metrics.csv"))
    return rounded(T.read_table(spark, path, schema=schemas.METRICS), "auc_roc", "precision", "recall", "f1_score")


@query(
    "S8_cluster_dictionary_json",
    f"""{terms_view()},
labels AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS label FROM top_terms WHERE rank <= 4 GROUP BY cluster)
SELECT 'documents' AS tab, '{{' || string_agg('"' || CAST(cluster AS string) || '":"' || label || '"', ',' ORDER BY cluster) || '}}' AS clusters
FROM labels""",
)
def cluster_dictionary_json(spark, sf_dir):
    labels = cluster_keywords(document_groups(spark, sf_dir), ["cluster"], "doc_id").select(
        F.lit("documents").alias("tab"), F.col("cluster").cast("int").alias("cluster_id"), "label"
    )
    path = T.write_cluster_json(labels, scratch_path(spark, "clusters"))
    read = T.read_table(spark, path, "json", schemas.CLUSTER_DICTIONARY)
    return T.cluster_json(read)


@query(
    "S11_splits_present",
    f"{_ALL('split_semantic')} SELECT split, count(*) AS rows FROM split_semantic GROUP BY split",
)
def splits_present(spark, sf_dir):
    return T.splits_present(X.split_semantic(spark, sf_dir))


# ------------------------------------------------------------------ preparation
@query(
    "P1_create_target",
    f"{_ALL('tickets')} SELECT PROTOCOLO, CAST(ULTIMO_CANCELAMENTO IS NOT NULL AS INTEGER) AS TARGET FROM tickets",
)
def create_target(spark, sf_dir):
    return add_target(X.tickets(spark, sf_dir)).select("PROTOCOLO", "TARGET")


@query(
    "P2_drop_leak_columns",
    f"""{_ALL('tickets')} SELECT DATA_REGISTRO, CANAL, TAB_N1, TAB_N2, TAB_N3, TICKET_MEDIO, IDADE_APROX, MESES FROM tickets""",
)
def drop_leak_columns(spark, sf_dir):
    return drop_leaks(X.tickets(spark, sf_dir))


@query(
    "M0_prepare",
    f"""{_ALL('split_semantic')} SELECT DATA_REGISTRO, CANAL, TAB_N1, TAB_N2, TAB_N3, t.TICKET_MEDIO, t.IDADE_APROX, t.MESES,
  TARGET, split FROM tickets t JOIN split_semantic s USING (PROTOCOLO)""",
)
def prepare_tickets(spark, sf_dir):
    return prepare(X.tickets(spark, sf_dir))


@query("M1_stratified_split", f"{_ALL('split_semantic')} SELECT PROTOCOLO, TARGET, split FROM split_semantic")
def stratified_split(spark, sf_dir):
    return X.split_semantic(spark, sf_dir).select("PROTOCOLO", "TARGET", "split")


@query(
    "P22_preview_profile",
    f"""{_ALL('tickets')},
known AS (UNPIVOT (SELECT count(*) AS rows, {', '.join(f'count({f.name}) AS {f.name}' for f in schemas.RAW_TICKETS.fields)}
  FROM tickets) ON {', '.join(f.name for f in schemas.RAW_TICKETS.fields)} INTO NAME column_name VALUE known)
SELECT column_name, rows, known, rows - known AS missing, round(known * 100.0 / rows, 6) AS known_pct FROM known""",
)
def preview_profile(spark, sf_dir):
    return rounded(profile.missing_values(X.tickets(spark, sf_dir)), "known_pct")


@query(
    "F10_null_counts",
    f"""{_ALL('tickets')} SELECT CANAL, count(ULTIMO_CANCELAMENTO) AS known, count(*) - count(ULTIMO_CANCELAMENTO) AS missing,
  count(TAB_N2) AS known_tab_n2 FROM tickets GROUP BY CANAL""",
)
def null_counts(spark, sf_dir):
    counts = profile.known_and_missing(X.tickets(spark, sf_dir), ["CANAL"], ["ULTIMO_CANCELAMENTO", "TAB_N2"])
    return counts.select(
        "CANAL",
        F.col("known_ULTIMO_CANCELAMENTO").alias("known"),
        F.col("missing_ULTIMO_CANCELAMENTO").alias("missing"),
        F.col("known_TAB_N2").alias("known_tab_n2"),
    )


@query("O6_head_preview", f"{_ALL('tickets')} SELECT * FROM tickets ORDER BY PROTOCOLO LIMIT 2")
def head_preview(spark, sf_dir):
    return profile.preview(X.tickets(spark, sf_dir), ["PROTOCOLO"], 2)


# ------------------------------------------------------------------ profiles
_LABELLED = f"{_ALL('tickets')}, labelled AS (SELECT *, CASE WHEN ULTIMO_CANCELAMENTO IS NULL THEN 0 ELSE 1 END AS TARGET FROM tickets)"


@query(
    "A1_label_distribution",
    f"""{_LABELLED} SELECT count(*) AS total, count(*) FILTER (WHERE TARGET = 0) AS active, count(*) FILTER (WHERE TARGET = 1) AS cancelled,
  round(avg(TARGET) * 100, 6) AS cancelled_pct FROM labelled""",
)
def label_distribution(spark, sf_dir):
    return rounded(profile.label_distribution(add_target(X.tickets(spark, sf_dir))), "cancelled_pct")


@query(
    "A2_split_distribution",
    f"""{_ALL('split_semantic')} SELECT split, count(*) AS rows, count(*) FILTER (WHERE TARGET = 0) AS label_0,
  count(*) FILTER (WHERE TARGET = 1) AS label_1, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS pct
  FROM split_semantic GROUP BY split""",
)
def split_distribution(spark, sf_dir):
    return rounded(profile.split_distribution(X.split_semantic(spark, sf_dir)), "pct")


@query(
    "A3_value_counts",
    f"{_LABELLED} SELECT TARGET, count(*) AS rows FROM labelled GROUP BY TARGET",
)
def value_counts(spark, sf_dir):
    return profile.value_counts(add_target(X.tickets(spark, sf_dir)), "TARGET")


_SUMS = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in INDICATORS)


@query(
    "A4_feature_occurrences",
    f"""{feature_view()} SELECT feature, occurrences FROM (UNPIVOT (SELECT {_SUMS} FROM tickets_features)
  ON {', '.join(INDICATORS)} INTO NAME feature VALUE occurrences)""",
)
def feature_occurrences(spark, sf_dir):
    return occurrences(build_features(X.tickets_semantic(spark, sf_dir)), list(INDICATORS))


_DUPLICATES = """SELECT count(*) AS rows, count(DISTINCT ID_CLIENTE) AS customers, count(*) - count(DISTINCT ID_CLIENTE) AS surplus,
  round(count(*) / count(DISTINCT ID_CLIENTE), 6) AS mean_rows"""


@query("A5_customer_duplicates", f"{_ALL('tickets')} {_DUPLICATES} FROM tickets")
def customer_duplicates(spark, sf_dir):
    return rounded(profile.customer_duplicates(X.tickets(spark, sf_dir)), "mean_rows")


@query("A6_rows_per_customer", f"{_ALL('tickets')} SELECT ID_CLIENTE, count(*) AS rows FROM tickets GROUP BY ID_CLIENTE")
def rows_per_customer(spark, sf_dir):
    return profile.rows_per_customer(X.tickets(spark, sf_dir))


@query("A7_train_duplicates", f"{_ALL('split_semantic')} {_DUPLICATES} FROM split_semantic WHERE split = 'train'")
def train_duplicates(spark, sf_dir):
    train = X.split_semantic(spark, sf_dir).filter(F.col("split") == "train")
    return rounded(profile.customer_duplicates(train), "mean_rows")


@query(
    "O1_top_customers",
    f"{_ALL('tickets')} SELECT ID_CLIENTE, count(*) AS rows FROM tickets GROUP BY 1 ORDER BY rows DESC, ID_CLIENTE LIMIT 10",
)
def top_customers(spark, sf_dir):
    return profile.top_customers(X.tickets(spark, sf_dir))


@query(
    "F9_rates_and_deltas",
    f"""{_LABELLED}, rates AS (SELECT CANAL, count(*) AS total, CAST(sum(TARGET) AS BIGINT) AS cancelled, avg(TARGET) * 100 AS rate
  FROM labelled GROUP BY CANAL)
SELECT CANAL, total, cancelled, round(rate, 6) AS rate_pct,
  round(rate - (SELECT avg(TARGET) * 100 FROM labelled), 6) AS delta_pct FROM rates""",
)
def rates_and_deltas(spark, sf_dir):
    labelled = add_target(X.tickets(spark, sf_dir))
    return rounded(profile.rates(labelled, ["CANAL"]), "rate_pct", "delta_pct")


# ------------------------------------------------------------------ further splits and checks
_BY_CUSTOMER = f"""{_ALL('tickets_semantic')},
customers AS (SELECT ID_CLIENTE, max(TARGET) AS t FROM tickets_semantic GROUP BY ID_CLIENTE),
placed AS (SELECT ID_CLIENTE, row_number() OVER (PARTITION BY t ORDER BY md5(concat(CAST(ID_CLIENTE AS string), ':42'))) AS rn,
  count(*) OVER (PARTITION BY t) AS n FROM customers),
by_customer AS (SELECT ID_CLIENTE, CASE WHEN rn * 10 <= n * 8 THEN 'train' WHEN rn * 10 <= n * 9 THEN 'validation' ELSE 'test' END AS split
  FROM placed)"""


def _customer_split(spark, sf_dir):
    return split.customer_split(X.tickets_semantic(spark, sf_dir), salt_by=[params.TICKET])


@query("D1_customer_split", f"{_BY_CUSTOMER} SELECT PROTOCOLO, split FROM tickets_semantic JOIN by_customer USING (ID_CLIENTE)")
def customer_split(spark, sf_dir):
    return _customer_split(spark, sf_dir).select("PROTOCOLO", "split")


@query(
    "D1_split_overlap",
    f"""{_ALL('split_semantic')}, c AS (SELECT ID_CLIENTE, count(DISTINCT split) AS n FROM split_semantic GROUP BY ID_CLIENTE)
SELECT 'by_row' AS kind, count(*) AS customers, count(*) FILTER (WHERE n > 1) AS overlapping FROM c
UNION ALL SELECT 'by_customer', count(*), 0 FROM c""",
)
def split_overlap(spark, sf_dir):
    by_row = split.split_overlap(X.split_semantic(spark, sf_dir))
    by_customer = split.split_overlap(_customer_split(spark, sf_dir))
    return by_row.withColumn("kind", F.lit("by_row")).unionByName(by_customer.withColumn("kind", F.lit("by_customer")))


@query(
    "D2_temporal_split",
    f"""{_ALL('tickets')} SELECT PROTOCOLO, CASE WHEN DATA_REGISTRO < TIMESTAMP '2024-01-22' THEN 'train'
  WHEN DATA_REGISTRO < TIMESTAMP '2024-01-26' THEN 'validation' ELSE 'test' END AS split FROM tickets""",
)
def temporal_split(spark, sf_dir):
    placed = split.temporal_split(X.tickets(spark, sf_dir), "DATA_REGISTRO", "2024-01-22", "2024-01-26")
    return placed.select("PROTOCOLO", "split")


_TICKET_HASH = "md5(concat(CAST(PROTOCOLO AS string), ':42'))"


@query(
    "D2_temporal_shares",
    f"""{_ALL('tickets')}, o AS (SELECT PROTOCOLO, row_number() OVER (ORDER BY DATA_REGISTRO, {_TICKET_HASH}) - 1 AS place, count(*) OVER () AS n FROM tickets
  WHERE DATA_REGISTRO IS NOT NULL)
SELECT PROTOCOLO, CASE WHEN place < n * 8 // 10 THEN 'train' WHEN place < n * 9 // 10 THEN 'validation' ELSE 'test' END AS split FROM o""",
)
def temporal_shares(spark, sf_dir):
    """Cuts by time at exact shares of the rows."""
    return temporal.temporal_share_split(X.tickets(spark, sf_dir), "DATA_REGISTRO").select("PROTOCOLO", "split")


@query(
    "D2_temporal_shares_by_day",
    f"""{_ALL('tickets')}, o AS (SELECT PROTOCOLO, row_number() OVER (ORDER BY CAST(DATA_REGISTRO AS DATE), {_TICKET_HASH}) - 1 AS place, count(*) OVER () AS n
  FROM tickets WHERE DATA_REGISTRO IS NOT NULL)
SELECT PROTOCOLO, CASE WHEN place < n * 5 // 10 THEN 'train' WHEN place < n * 7 // 10 THEN 'validation' ELSE 'test' END AS split FROM o""",
)
def temporal_shares_by_day(spark, sf_dir):
    """The same where very many rows have one time."""
    days = X.tickets(spark, sf_dir).withColumn("DAY", F.col("DATA_REGISTRO").cast("date"))
    return temporal.temporal_share_split(days, "DAY", shares=(0.5, 0.2, 0.3)).select("PROTOCOLO", "split")


@query(
    "D5_metrics_per_period",
    f"""{_ALL('tickets')}, known AS (SELECT *, CASE WHEN ULTIMO_CANCELAMENTO IS NOT NULL THEN 1 ELSE 0 END AS TARGET FROM tickets),
s AS (SELECT CAST(date_trunc('week', DATA_REGISTRO) AS DATE) AS period, TARGET AS y, {X.SCORE} FROM known WHERE DATA_REGISTRO IS NOT NULL),
g AS (SELECT period, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY period, p),
r AS (SELECT *, sum(neg) OVER (PARTITION BY period ORDER BY p) - neg AS below FROM g),
a AS (SELECT period, sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + CAST(neg AS DOUBLE) / 2)) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc_roc
  FROM r GROUP BY period),
c AS (SELECT period, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
  count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp FROM s GROUP BY period),
m AS (SELECT period, rows, positives, auc_roc, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(positives, 0), 0) AS recall, coalesce(CAST(2 * tp AS DOUBLE) / nullif(tp + fp + positives, 0), 0) AS f1_score FROM c JOIN a USING (period))
SELECT period, rows, positives, round(auc_roc, 6) AS auc_roc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  round(first_value(auc_roc IGNORE NULLS) OVER w - auc_roc, 6) AS auc_decay, round(first_value(f1_score) OVER w - f1_score, 6) AS f1_decay
FROM m WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def metrics_per_period(spark, sf_dir):
    """How a model's metrics change with the weeks."""
    tickets = temporal.with_period(add_target(X.tickets(spark, sf_dir)), "DATA_REGISTRO", "week")
    scored = tickets.select("period", F.col("TARGET").alias("y"), F.expr(X.SCORE))
    names = ("auc_roc", "precision", "recall", "f1_score", "auc_decay", "f1_decay")
    return rounded(temporal.metrics_per_period(scored, 0.5), *names)


@query(
    "D3_customer_folds",
    f"""{_ALL('tickets')} SELECT PROTOCOLO, CAST(CAST('0x' || substr(md5(concat(CAST(ID_CLIENTE AS string), ':42')), 1, 12) AS BIGINT) % 5
  AS INTEGER) AS fold FROM tickets""",
)
def customer_folds(spark, sf_dir):
    return split.customer_folds(X.tickets(spark, sf_dir), 5).select("PROTOCOLO", "fold")


@query(
    "D5_identifier_check",
    f"""{_ALL('tickets')}, v AS (SELECT TICKET_MEDIO, count(DISTINCT ID_CLIENTE) AS c FROM tickets WHERE TICKET_MEDIO IS NOT NULL GROUP BY 1)
SELECT count(*) AS values, count(*) FILTER (WHERE c = 1) AS single_customer_values, round(avg(c), 6) AS mean_customers,
  max(c) AS max_customers, round(count(*) FILTER (WHERE c = 1) * 100.0 / count(*), 6) AS single_pct FROM v""",
)
def identifier_check(spark, sf_dir):
    return rounded(profile.identifier_check(X.tickets(spark, sf_dir), "TICKET_MEDIO"), "mean_customers", "single_pct")


_PROFILED = ["PROTOCOLO", *INPUTS]
_EXACT = f"""{feature_view('tickets_semantic')}, cells AS (SELECT ID_CLIENTE AS customer, {', '.join(
    f"CAST({f'round({c}, 6)' if c in ROUNDED else c} AS VARCHAR) AS {c}" for c in _PROFILED)} FROM tickets_features),
long AS (UNPIVOT cells ON {', '.join(_PROFILED)} INTO NAME feature VALUE v),
c AS (SELECT feature, v, count(DISTINCT customer) AS customers FROM long GROUP BY ALL),
counted AS (SELECT feature, count(*) AS values, CAST(sum(customers) AS BIGINT) AS pairs FROM c GROUP BY feature)"""


def _profiled(spark, sf_dir):
    """The ticket number and all model inputs."""
    features = build_features(X.tickets_semantic(spark, sf_dir))
    return rounded(features.select("ID_CLIENTE", *_PROFILED), *ROUNDED)


@query(
    "D5_identifying_features",
    f"{_EXACT} SELECT feature, CAST(pairs AS DOUBLE) / CAST(values AS DOUBLE) <= CAST(1.05 AS DOUBLE) AS identifying FROM counted",
)
def identifying_features(spark, sf_dir):
    """All columns from one scan; those near the limit counted exactly."""
    return profile.identifying_features(_profiled(spark, sf_dir), _PROFILED).select("feature", "identifying")


@query("D5_identifier_counts", f"{_EXACT} SELECT feature, values, pairs, true AS estimated_well FROM counted")
def identifier_counts(spark, sf_dir):
    """Exact counts of all columns, and whether the sketches lie within four deviations of them."""
    df = _profiled(spark, sf_dir)
    sketched = profile.identifier_sketches(df, _PROFILED).toDF("feature", "about_values", "about_pairs")
    margin = 4 * 1.04 / 2 ** (profile.SKETCH_BITS / 2)
    return profile.identifier_counts(df, _PROFILED).join(sketched, "feature").select(
        "feature", "values", "pairs",
        ((F.abs(F.col("about_values") - F.col("values")) <= margin * F.col("values"))
         & (F.abs(F.col("about_pairs") - F.col("pairs")) <= margin * F.col("pairs"))).alias("estimated_well"),
    )


@query(
    "D6_drift",
    f"""{_ALL('split_semantic')},
long AS (UNPIVOT (SELECT split, CAST(TICKET_MEDIO AS DOUBLE) AS TICKET_MEDIO, CAST(IDADE_APROX AS DOUBLE) AS IDADE_APROX,
  TAB_N3_SENT_SCORE FROM split_semantic) ON TICKET_MEDIO, IDADE_APROX, TAB_N3_SENT_SCORE INTO NAME feature VALUE v),
r AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long WHERE split = 'train' GROUP BY feature),
h AS (SELECT feature, split, least(greatest(CAST(floor((v - lo) / (hi - lo) * 10) AS INTEGER), 0), 9) AS bin, count(*) AS c
  FROM long JOIN r USING (feature) GROUP BY ALL),
cells AS (SELECT feature, split, unnest(range(10)) AS bin FROM (SELECT DISTINCT feature, split FROM h)),
shares AS (SELECT feature, split, bin, coalesce(c, 0) AS c,
  greatest(CAST(coalesce(c, 0) AS DOUBLE) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY feature, split) AS DOUBLE), 0.0001::DOUBLE) AS share
  FROM cells LEFT JOIN h USING (feature, split, bin))
SELECT s.feature, s.split, CAST(sum(s.c) AS BIGINT) AS rows, round(sum((s.share - b.share) * ln(s.share / b.share)), 6) AS psi
FROM shares s JOIN shares b ON b.feature = s.feature AND b.bin = s.bin AND b.split = 'train' GROUP BY s.feature, s.split""",
)
def drift(spark, sf_dir):
    features = ["TICKET_MEDIO", "IDADE_APROX", "TAB_N3_SENT_SCORE"]
    return rounded(profile.drift(X.split_semantic(spark, sf_dir), features), "psi")
