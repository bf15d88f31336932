"""Parameters of the ticket analytics: plain data, no logic.

Everything here can be passed in as an argument instead; these are the defaults.
"""

# ---------------------------------------------------------------- fixed values
# Text levels of a ticket, coarse to fine, and the number of clusters for each.
CLUSTERS_PER_TAB = {"TAB_N1": 6, "TAB_N2": 12, "TAB_N3": 18}
DEFAULT_CLUSTERS = 12
SEED = 42

# Sentiment seeds: (text level, seed text, score).
SENTIMENT_SEEDS = [
    ("TAB_N1", "cancelamento", -0.8),
    ("TAB_N1", "reclamacao", -0.7),
    ("TAB_N1", "solicitacao", 0.2),
    ("TAB_N1", "agendamento", 0.3),
    ("TAB_N2", "inadimplencia", -0.9),
    ("TAB_N2", "cobranca", -0.8),
    ("TAB_N2", "bloqueio", -0.9),
    ("TAB_N2", "problema tecnico", -0.7),
    ("TAB_N2", "instalacao", 0.2),
    ("TAB_N2", "upgrade", 0.4),
    ("TAB_N2", "fidelizacao", 0.5),
    ("TAB_N3", "sem sinal", -1.0),
    ("TAB_N3", "sem audio", -1.0),
    ("TAB_N3", "nao navega", -1.0),
    ("TAB_N3", "lentidao", -0.9),
    ("TAB_N3", "oscilando", -0.9),
    ("TAB_N3", "quedas de conexao", -0.9),
    ("TAB_N3", "atendimento ruim", -1.0),
    ("TAB_N3", "revertido por insatisfacao", -1.0),
    ("TAB_N3", "cancelamento", -1.0),
    ("TAB_N3", "desistencia do servico", -0.8),
    ("TAB_N3", "problema tecnico", -0.6),
    ("TAB_N3", "bloqueado por debitos", -0.9),
    ("TAB_N3", "negativacao", -0.9),
    ("TAB_N3", "clube de vantagens", 0.5),
    ("TAB_N3", "oferta de desconto", 0.7),
    ("TAB_N3", "confirmacao de agendamento", 0.2),
    ("TAB_N3", "solicitacao de upgrade", 0.3),
    ("TAB_N3", "nova ordem de instalacao", 0.4),
    ("TAB_N3", "retencao", 0.3),
    ("TAB_N3", "fidelizacao", 0.5),
]

# Critical clusters: (text level, indicator name, exact cluster label).
CRITICAL_CLUSTERS = [
    ("TAB_N1", "reclamacao", "reclamação, sugestão, elogios, denuncia"),
    ("TAB_N1", "cobranca", "ativo cobrança, cobrança, ativo, gestão base"),
    ("TAB_N2", "sem_conexao", "sem conexão, conexão, sem, debitos aberto"),
    ("TAB_N2", "cobranca", "cobrança, celula cobrança, celula"),
    ("TAB_N3", "cobranca_inadimplencia", "cobrança inadimplencia, inadimplencia, cobrança, ligação cobrança"),
    ("TAB_N3", "sem_sinal", "sem sinal, sem, sinal, lentidão"),
    ("TAB_N3", "bloqueado", "bloqueado, bloqueado debitos, debitos, debitos aberto"),
    ("TAB_N3", "cancelamento_ura", "ura, cancelamento, cancelamento ura, tds ptos"),
    ("TAB_N3", "nao_navega", "não navega, navega, não, adesão"),
    ("TAB_N3", "oscilando", "oscilando"),
    ("TAB_N3", "info_cancelamento", "informações, sobre, cancelamento, sobre cancelamento"),
]
SEVERE_TECHNICAL_LABELS = [
    "sem sinal, sem, sinal, lentidão",
    "não navega, navega, não, adesão",
    "oscilando",
]
BILLING_PATTERN = "cobrança|inadimplencia"
CANCELLATION_PATTERN = "cancelamento"
BLOCKED_PATTERN = "bloqueado|desbloqueio"

NEGATIVE, NEUTRAL, POSITIVE = "insatisfacao", "neutro", "positivo"
SENTIMENT_BOUNDS = (-0.5, 0.5)

STOPWORDS = (
    "a ao aos as e o os da das do dos de em um uma por para no na nos nas como que com"
).split()
EMPTY_CLUSTER_LABEL = "cluster_vazio"
KEYWORDS_PER_CLUSTER = 4

# Columns removed when the label is made (identifiers and leaks) ...
LABEL_SOURCE = "ULTIMO_CANCELAMENTO"
LABEL = "TARGET"
CUSTOMER = "ID_CLIENTE"
TICKET = "PROTOCOLO"
LEAK_COLUMNS = ["ULTIMO_CANCELAMENTO", "ID_CLIENTE", "CODIGO", "PROTOCOLO", "NUMERO_OS", "SITUACAO"]
# ... and before a model is trained.
NON_MODEL_COLUMNS = [
    "TARGET", "TAB_N1", "TAB_N2", "TAB_N3",
    "TAB_N1_GROUP", "TAB_N2_GROUP", "TAB_N3_GROUP",
    "TAB_N1_SENT_LABEL", "TAB_N2_SENT_LABEL", "TAB_N3_SENT_LABEL",
    "DESCRICAO_OS", "PROBLEMA_ENCONTRADO", "STATUS_OS", "OBS_ABERTURA",
    "CANAL", "GENERO", "SERVICO", "PROFISSAO",
    "CIDADE_x", "BAIRRO_x", "CIDADE_y", "BAIRRO_y",
    "DATA_REGISTRO", "HORA_REGISTRO", "ULTIMO_CORTE_INAD",
    "SITUACAO", "LIGACAO_RECORRENTE", "GEROU_OS",
]

SPLITS = ("train", "validation", "test")
SPLIT_SHARES = (0.8, 0.1, 0.1)

BOOSTING = {"trees": 100, "rate": 0.1, "depth": 5}
DECISION_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
FALLBACK_THRESHOLD = 0.5
OVERFIT_DELTA = 0.05
OVERFIT_POINTS = 3.0
GATE_F1, GATE_AUC = 0.95, 0.99
SAME_RUN, CLOSE_RUN = 0.001, 0.01

# Metrics of the stored run that new runs are compared with:
# (dataset, auc_roc, precision, recall, f1_score).
STORED_METRICS = [
    ("train", 0.9992, 0.9647, 0.9538, 0.9592),
    ("validation", 0.9965, 0.9537, 0.9477, 0.9507),
    ("test", 0.9941, 0.9600, 0.9495, 0.9547),
]

# Report kind of a feature: the first rule with a matching part of the name wins.
FEATURE_KINDS = [
    (["count_"], "Contador"),
    (["prop_", "sent_score_"], "Sentimento"),
    (["escalation_", "degradacao_"], "Escalation"),
    (["flag_"], "Flag Crítica"),
    (["_mean", "_std", "_min", "_max"], "Agregação"),
]
OTHER_KIND = "Original"
# ------------------------------------------------------------ end fixed values

#: Ending of the columns that hold a text level's cluster id.
CLUSTER_SUFFIX = "_CLUSTER"
