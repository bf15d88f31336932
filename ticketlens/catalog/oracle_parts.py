"""Pieces of oracle SQL that several queries share. Written by hand, not derived from the Spark expressions.

Names of indicators and the labels and patterns they match are fixed values.
"""

from __future__ import annotations

from ticketlens.fixtures import oracle_views


def _is(column: str, text: str) -> str:
    return f"CASE WHEN {column} = '{text}' THEN 1 ELSE 0 END"


def _has(column: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '{pattern}', 'i') THEN 1 ELSE 0 END"


COUNTS = {
    "count_tab_n1_reclamacao": _is("TAB_N1_GROUP", "reclamação, sugestão, elogios, denuncia"),
    "count_tab_n1_cobranca": _is("TAB_N1_GROUP", "ativo cobrança, cobrança, ativo, gestão base"),
    "count_tab_n2_sem_conexao": _is("TAB_N2_GROUP", "sem conexão, conexão, sem, debitos aberto"),
    "count_tab_n2_cobranca": _is("TAB_N2_GROUP", "cobrança, celula cobrança, celula"),
    "count_tab_n3_cobranca_inadimplencia": _is(
        "TAB_N3_GROUP", "cobrança inadimplencia, inadimplencia, cobrança, ligação cobrança"
    ),
    "count_tab_n3_sem_sinal": _is("TAB_N3_GROUP", "sem sinal, sem, sinal, lentidão"),
    "count_tab_n3_bloqueado": _is("TAB_N3_GROUP", "bloqueado, bloqueado debitos, debitos, debitos aberto"),
    "count_tab_n3_cancelamento_ura": _is("TAB_N3_GROUP", "ura, cancelamento, cancelamento ura, tds ptos"),
    "count_tab_n3_nao_navega": _is("TAB_N3_GROUP", "não navega, navega, não, adesão"),
    "count_tab_n3_oscilando": _is("TAB_N3_GROUP", "oscilando"),
    "count_tab_n3_info_cancelamento": _is("TAB_N3_GROUP", "informações, sobre, cancelamento, sobre cancelamento"),
}
PROPS = {
    f"prop_tab_n{i}_{mood}": _is(f"TAB_N{i}_SENT_LABEL", mood)
    for i in (1, 2, 3)
    for mood in ("insatisfacao", "neutro", "positivo")
}
SCORES = {f"sent_score_tab_n{i}": f"coalesce(TAB_N{i}_SENT_SCORE, 0.0)" for i in (1, 2, 3)}
ESCALATIONS = {
    "escalation_n1_to_n3": "CASE WHEN TAB_N1_SENT_LABEL = 'neutro' AND TAB_N3_SENT_LABEL = 'insatisfacao' THEN 1 ELSE 0 END",
    "escalation_n2_to_n3": "CASE WHEN TAB_N2_SENT_LABEL = 'neutro' AND TAB_N3_SENT_LABEL = 'insatisfacao' THEN 1 ELSE 0 END",
    "degradacao_continua": "CASE WHEN TAB_N1_SENT_LABEL IN ('positivo', 'neutro') AND TAB_N2_SENT_LABEL IN ('neutro', "
    "'insatisfacao') AND TAB_N3_SENT_LABEL = 'insatisfacao' THEN 1 ELSE 0 END",
}
FLAGS = {
    "flag_problema_tecnico_grave": "CASE WHEN TAB_N3_GROUP IN ('sem sinal, sem, sinal, lentidão', "
    "'não navega, navega, não, adesão', 'oscilando') THEN 1 ELSE 0 END",
    "flag_teve_cobranca": _has(
        "concat_ws(chr(10), TAB_N1_GROUP, TAB_N2_GROUP, TAB_N3_GROUP)", "cobrança|inadimplencia"
    ),
    "flag_mencionou_cancelamento": _has("TAB_N3_GROUP", "cancelamento"),
    "flag_bloqueado": _has("TAB_N3_GROUP", "bloqueado|desbloqueio"),
    "flag_insatisfacao_n3": _is("TAB_N3_SENT_LABEL", "insatisfacao"),
}
_ALL_SCORES = "[TAB_N1_SENT_SCORE, TAB_N2_SENT_SCORE, TAB_N3_SENT_SCORE]"
SPREAD = {
    "sent_score_mean": f"round(list_avg({_ALL_SCORES}), 6)",
    "sent_score_min": f"list_min({_ALL_SCORES})",
    "sent_score_max": f"list_max({_ALL_SCORES})",
    "sent_score_std": f"round(coalesce(list_stddev_samp({_ALL_SCORES}), 0.0), 6)",
}
TOTALS = {
    f"count_{mood}_total": " + ".join(
        f"(CASE WHEN TAB_N{i}_SENT_LABEL = '{mood}' THEN 1 ELSE 0 END)" for i in (1, 2, 3)
    )
    for mood in ("insatisfacao", "positivo")
}
INDICATORS = {**COUNTS, **PROPS, **ESCALATIONS, **FLAGS}
FEATURES = {**COUNTS, **PROPS, **SCORES, **ESCALATIONS, **FLAGS, **SPREAD, **TOTALS}
ROUNDED = ("sent_score_mean", "sent_score_std")


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


def feature_view(source: str = "tickets_semantic") -> str:
    """WITH clause ending in ``tickets_features``."""
    return f"{oracle_views(source)},\ntickets_features AS (SELECT *, {select_list(FEATURES)} FROM {source})"


def row_features(columns: dict[str, str], source: str = "tickets_semantic") -> str:
    return f"{oracle_views(source)} SELECT PROTOCOLO, {select_list(columns)} FROM {source}"


# The 43 model inputs: raw numbers, raw scores, features.
INPUTS = [
    "TICKET_MEDIO", "IDADE_APROX", "MESES",
    "TAB_N1_SENT_SCORE", "TAB_N2_SENT_SCORE", "TAB_N3_SENT_SCORE",
    *FEATURES,
]


def importances_view() -> str:
    """A stand-in for learned importances: the share of each model input in all non-zero values."""
    sums = ", ".join(f"CAST(count(*) FILTER (WHERE coalesce({c}, 0) <> 0) AS BIGINT) AS {c}" for c in INPUTS)
    return (
        f"{feature_view()},\nnonzero AS (UNPIVOT (SELECT {sums} FROM tickets_features) "
        f"ON {', '.join(INPUTS)} INTO NAME feature VALUE hits),\n"
        "importances AS (SELECT feature, CAST(hits AS DOUBLE) / CAST(sum(hits) OVER () AS DOUBLE) AS importance FROM nonzero)"
    )


def metrics_view(threshold: float = 0.6) -> str:
    """WITH clause ending in ``conf`` (confusion counts), ``auc`` and ``metrics``."""
    t = f"CAST({threshold} AS DOUBLE)"
    return f"""{oracle_views("scored")},
by_score AS (SELECT split, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY split, p),
ranked_scores AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p) - neg AS below FROM by_score),
auc AS (SELECT split, sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + CAST(neg AS DOUBLE) / 2))
          / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc_roc FROM ranked_scores GROUP BY split),
conf AS (SELECT split, count(*) FILTER (WHERE p < {t} AND y = 0) AS tn, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp,
           count(*) FILTER (WHERE p < {t} AND y = 1) AS fn, count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp FROM scored GROUP BY split),
metrics AS (SELECT split AS dataset, auc_roc, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
              coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
              coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1_score FROM conf JOIN auc USING (split)),
stored AS (SELECT * FROM (VALUES ('train', 0.9992::DOUBLE, 0.9647::DOUBLE, 0.9538::DOUBLE, 0.9592::DOUBLE),
  ('validation', 0.9965, 0.9537, 0.9477, 0.9507), ('test', 0.9941, 0.96, 0.9495, 0.9547))
  t(dataset, s_auc_roc, s_precision, s_recall, s_f1_score))"""


STOP = (
    "('a','ao','aos','as','e','o','os','da','das','do','dos','de','em','um','uma','por','para','no','na','nos','nas',"
    "'como','que','com')"
)
TOKENS = (
    r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda w: w NOT IN " + STOP + ")"
)


def terms_view() -> str:
    """WITH clause ending in ``term_scores``: mean TF-IDF per term of each document group."""
    return f"""WITH words AS (SELECT doc_id % 6 AS cluster, doc_id, {TOKENS} AS w FROM documents),
grams AS (SELECT cluster, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
            FROM words),
tf AS (SELECT cluster, doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
corpus AS (SELECT doc_id % 6 AS cluster, count(*) AS n FROM documents GROUP BY 1),
df AS (SELECT cluster, term, count(*) AS df FROM tf GROUP BY ALL),
weighed AS (SELECT cluster, doc_id, term, n, tf * (ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1) AS w
              FROM tf JOIN df USING (cluster, term) JOIN corpus USING (cluster)),
norms AS (SELECT cluster, doc_id, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
term_scores AS (SELECT cluster, term, sum(w / norm) / n AS score FROM weighed JOIN norms USING (cluster, doc_id) GROUP BY cluster, term, n),
top_terms AS (SELECT cluster, term, round(score, 9) AS score,
                row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank FROM term_scores)"""
