"""Surrogate ticket tables over the driver tables.

The projections are kept as text because the very same text is run by the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import params, schemas
from ticketlens.operators.split import stratified_split
from ticketlens.sources.tables import read_table

# ---- fixed values: label strings of the tables the library is meant for
TICKETS = [
    "user_id AS ID_CLIENTE",
    "event_id % 997 AS CODIGO",
    "event_id AS PROTOCOLO",
    "event_id * 10 + 1 AS NUMERO_OS",
    "CASE WHEN event_type = 'error' AND value > 60 THEN ts END AS ULTIMO_CANCELAMENTO",
    "CASE WHEN event_type = 'error' AND value > 60 THEN 'CANCELADO' ELSE 'ATIVO' END AS SITUACAO",
    "ts AS DATA_REGISTRO",
    "event_type AS CANAL",
    """CASE event_id % 4 WHEN 0 THEN 'Cancelamento' WHEN 1 THEN 'Reclamação' WHEN 2 THEN 'Solicitação'
         ELSE 'Agendamento' END AS TAB_N1""",
    """CASE WHEN event_id % 29 = 0 THEN NULL ELSE CASE event_id % 7 WHEN 0 THEN 'Inadimplência' WHEN 1 THEN 'Cobrança'
         WHEN 2 THEN 'Bloqueio' WHEN 3 THEN 'Problema técnico' WHEN 4 THEN 'Instalação' WHEN 5 THEN 'Upgrade'
         ELSE 'Fidelização' END END AS TAB_N2""",
    """CASE event_id % 11 WHEN 0 THEN 'Sem sinal' WHEN 1 THEN 'Não navega' WHEN 2 THEN 'Lentidão' WHEN 3 THEN 'Oscilando'
         WHEN 4 THEN 'Quedas de conexão' WHEN 5 THEN 'Bloqueado por débitos' WHEN 6 THEN 'Oferta de desconto'
         WHEN 7 THEN 'Informações sobre cancelamento' WHEN 8 THEN 'Nova ordem de instalação' WHEN 9 THEN 'Retenção'
         ELSE 'COBRANÇA inadimplencia' END AS TAB_N3""",
    "value AS TICKET_MEDIO",
    "18 + user_id % 60 AS IDADE_APROX",
    "user_id % 84 AS MESES",
]

SEMANTIC_BASE = [
    "PROTOCOLO", "ID_CLIENTE", "TICKET_MEDIO", "IDADE_APROX", "MESES",
    "CASE WHEN ULTIMO_CANCELAMENTO IS NOT NULL THEN 1 ELSE 0 END AS TARGET",
    """CASE PROTOCOLO % 4 WHEN 0 THEN 'reclamação, sugestão, elogios, denuncia'
         WHEN 1 THEN 'ativo cobrança, cobrança, ativo, gestão base' WHEN 2 THEN 'agendamento' END AS TAB_N1_GROUP""",
    """CASE PROTOCOLO % 5 WHEN 0 THEN 'sem conexão, conexão, sem, debitos aberto'
         WHEN 1 THEN 'cobrança, celula cobrança, celula' WHEN 2 THEN 'COBRANÇA' ELSE 'upgrade' END AS TAB_N2_GROUP""",
    """CASE PROTOCOLO % 10 WHEN 0 THEN 'cobrança inadimplencia, inadimplencia, cobrança, ligação cobrança'
         WHEN 1 THEN 'sem sinal, sem, sinal, lentidão' WHEN 2 THEN 'bloqueado, bloqueado debitos, debitos, debitos aberto'
         WHEN 3 THEN 'ura, cancelamento, cancelamento ura, tds ptos' WHEN 4 THEN 'não navega, navega, não, adesão'
         WHEN 5 THEN 'oscilando' WHEN 6 THEN 'informações, sobre, cancelamento, sobre cancelamento'
         WHEN 7 THEN 'desbloqueio' WHEN 8 THEN 'retenção' END AS TAB_N3_GROUP""",
    "CASE WHEN PROTOCOLO % 13 = 0 THEN NULL ELSE CAST(PROTOCOLO * 37 % 2001 - 1000 AS DOUBLE) / 1000 END AS TAB_N1_SENT_SCORE",
    "CASE WHEN PROTOCOLO % 17 = 0 THEN NULL ELSE CAST(PROTOCOLO * 53 % 2001 - 1000 AS DOUBLE) / 1000 END AS TAB_N2_SENT_SCORE",
    "CASE WHEN PROTOCOLO % 19 = 0 THEN NULL ELSE CAST(PROTOCOLO * 71 % 2001 - 1000 AS DOUBLE) / 1000 END AS TAB_N3_SENT_SCORE",
]
SEMANTIC_LABELS = [
    f"CASE WHEN TAB_N{i}_SENT_SCORE <= -0.5 THEN 'insatisfacao' WHEN TAB_N{i}_SENT_SCORE >= 0.5 THEN 'positivo' "
    f"ELSE 'neutro' END AS TAB_N{i}_SENT_LABEL"
    for i in (1, 2, 3)
]
# ---- end of fixed values
SCORE = "CAST(PROTOCOLO * 7919 % 601 + TARGET * 350 AS DOUBLE) / 1000 AS p"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/events.parquet", schema=schemas.EVENTS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", schema=schemas.DOCUMENTS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/embeddings.parquet", schema=schemas.EMBEDDINGS)


def as_tickets(events_df: DataFrame) -> DataFrame:
    return events_df.selectExpr(*TICKETS)


def as_semantic(tickets_df: DataFrame) -> DataFrame:
    return tickets_df.selectExpr(*SEMANTIC_BASE).selectExpr("*", *SEMANTIC_LABELS)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_tickets(events(spark, sf_dir))


def tickets_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_semantic(tickets(spark, sf_dir))


def split_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(tickets_semantic(spark, sf_dir), params.LABEL, params.TICKET)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = split_semantic(spark, sf_dir)
    return split.select("PROTOCOLO", "split", F.col("TARGET").alias("y"), F.expr(SCORE))


# ------------------------------------------------------------------ the same views for the SQL oracle
_VIEWS = {
    "tickets": ("", f"SELECT {', '.join(TICKETS)} FROM events"),
    "semantic_base": ("tickets", f"SELECT {', '.join(SEMANTIC_BASE)} FROM tickets"),
    "tickets_semantic": ("semantic_base", f"SELECT *, {', '.join(SEMANTIC_LABELS)} FROM semantic_base"),
    "ranked": (
        "tickets_semantic",
        """SELECT *, ROW_NUMBER() OVER (PARTITION BY TARGET ORDER BY md5(concat(CAST(PROTOCOLO AS string), ':42'))) AS rn,
             COUNT(*) OVER (PARTITION BY TARGET) AS n FROM tickets_semantic""",
    ),
    "split_semantic": (
        "ranked",
        """SELECT * EXCLUDE (rn, n), CASE WHEN rn * 10 <= n * 8 THEN 'train' WHEN rn * 10 <= n * 9 THEN 'validation'
             ELSE 'test' END AS split FROM ranked""",
    ),
    "scored": ("split_semantic", f"SELECT PROTOCOLO, split, TARGET AS y, {SCORE} FROM split_semantic"),
}


def oracle_views(last: str) -> str:
    """``WITH`` clause that defines the view ``last`` and those it is built on."""
    chain = []
    while last:
        parent, text = _VIEWS[last]
        chain.append(f"{last} AS ({text})")
        last = parent
    return "WITH " + ",\n".join(reversed(chain))
