"""Hand-made edge rows for label, sentiment, features and text functions."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from ticketlens import params
from ticketlens.functions import text as TX
from ticketlens.operators import features as B
from ticketlens.operators.prepare import add_target, drop_leaks
from ticketlens.operators.training import feature_matrix, input_names
from ticketlens.sources.tables import nan_to_null


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_sentiment_bounds(spark):
    scores = [-0.5, 0.5, -0.4999, 0.4999, None, math.nan]
    got = column(spark, scores, "double", TX.label_sentiment)
    assert got == ["insatisfacao", "positivo", "neutro", "neutro", "neutro", "neutro"]


def test_row_aggregates(spark):
    rows = [(0, None, None, None), (1, 0.2, None, None), (2, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "i int, TAB_N1_SENT_SCORE double, TAB_N2_SENT_SCORE double, TAB_N3_SENT_SCORE double")
    got = B.build_features(df).orderBy("i").collect()
    assert [r.sent_score_mean for r in got] == [None, 0.2, pytest.approx(0.2)]
    assert [r.sent_score_min for r in got] == [None, 0.2, 0.1]
    assert [r.sent_score_max for r in got] == [None, 0.2, 0.3]
    assert [r.sent_score_std for r in got] == [0.0, 0.0, pytest.approx(0.1)]


def test_flags(spark):
    groups = ["COBRANÇA", "Inadimplencia", None, "", "desbloqueio", "CANCELAMENTO da conta"]
    df = spark.createDataFrame(list(enumerate(groups)), "i int, TAB_N3_GROUP string")
    got = B.build_features(df).orderBy("i").collect()
    assert [r.flag_teve_cobranca for r in got] == [1, 1, 0, 0, 0, 0]
    assert [r.flag_bloqueado for r in got] == [0, 0, 0, 0, 1, 0]
    assert [r.flag_mencionou_cancelamento for r in got] == [0, 0, 0, 0, 0, 1]


def test_schema_gaps():
    assert list(B.feature_columns(["x"])) == ["flag_teve_cobranca"]
    without_n2 = [f"TAB_N{i}_{k}" for i in (1, 3) for k in ("GROUP", "SENT_SCORE", "SENT_LABEL")]
    names = list(B.feature_columns(without_n2))
    assert not any("tab_n2" in n for n in names)
    assert "escalation_n1_to_n3" in names and "escalation_n2_to_n3" not in names and "degradacao_continua" not in names
    everything = [f"TAB_N{i}_{k}" for i in (1, 2, 3) for k in ("GROUP", "SENT_SCORE", "SENT_LABEL")]
    assert len(B.feature_columns(everything)) == 37
    assert "sent_score_tab_n1" not in B.feature_columns(["TAB_N1_SENT_SCORE"])  # only beside its label


def test_all_groups_missing_gives_zero(spark):
    assert B.build_features(spark.range(2)).select("flag_teve_cobranca").distinct().collect()[0][0] == 0


def test_target_and_leaks(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "2024", "y")], "PROTOCOLO int, ULTIMO_CANCELAMENTO string, TAB_N1 string")
    labelled = add_target(df)
    assert [r.TARGET for r in labelled.orderBy("PROTOCOLO").collect()] == [0, 1]
    assert drop_leaks(labelled).columns == ["TAB_N1", "TARGET"]
    with pytest.raises(ValueError):
        add_target(df.drop("ULTIMO_CANCELAMENTO"))


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(math.nan, 1), (0.5, 2)], "a double, b int"))
    assert [r.a for r in df.orderBy("b").collect()] == [None, 0.5]


def test_feature_matrix(spark):
    schema = "split string, TARGET double, TAB_N1 string, TICKET_MEDIO double, MESES int, DATA_REGISTRO string"
    rows = [("train", None, "a", None, 3, "x"), ("test", 1.0, "b", 2.5, None, "y")]
    matrix = feature_matrix(spark.createDataFrame(rows, schema))
    assert input_names(matrix) == ["TICKET_MEDIO", "MESES"]
    got = {r.split: r for r in matrix.collect()}
    assert (got["train"].label, got["train"].TICKET_MEDIO, got["train"].MESES) == (0, 0.0, 3)
    assert (got["test"].label, got["test"].TICKET_MEDIO, got["test"].MESES) == (1, 2.5, 0)


def test_feature_kind_order(spark):
    names = ["count_insatisfacao_total", "sent_score_mean", "prop_tab_n1_neutro", "flag_bloqueado", "degradacao_continua", "x_std", "MESES"]
    kinds = ["Contador", "Sentimento", "Sentimento", "Flag Crítica", "Escalation", "Agregação", "Original"]
    assert column(spark, names, "string", TX.feature_kind) == kinds


TEXTS = [None, "", "   ", "sinal", "para que com", "NÃO navega", "erro 404 na linha 7", "  Ação  ", "ß Œ ﬁ ½ …", "a_b c"]


def test_prepare_text(spark):
    want = ["nan" if t is None else t.strip() for t in TEXTS]
    assert column(spark, TEXTS, "string", TX.prepare_text) == want
    assert column(spark, [None], "string", lambda c: TX.prepare_text(c, "")) == [""]


def _fold(text):
    return "" if text is None else unicodedata.normalize("NFKD", text.upper()).encode("ascii", "ignore").decode().strip()


def test_normalize_text(spark):
    texts = TEXTS + ["½ dose", "ạ Ạ", "Ǆ ﬁm ™", "日本 ㎏ №", "𝐀𝐁 ℡", "ŉ x"]
    assert column(spark, texts, "string", TX.normalize_text) == [_fold(t) for t in texts]


def test_tokens_and_grams(spark):
    got = column(spark, ["NÃO navega", "para que com", "", "erro 404 na linha 7", "a_b c"], "string", TX.tokens)
    assert got == [["não", "navega"], [], [], ["erro", "404", "linha"], ["a_b"]]
    grams = column(spark, [["a", "b", "a"], ["x"], []], "array<string>", TX.one_and_two_grams)
    assert grams == [["a", "b", "a", "a b", "b a"], ["x"], []]
    counts = column(spark, [["b", "a", "b"], []], "array<string>", TX.term_counts)
    assert [[(c.term, c.tf) for c in row] for row in counts] == [[("a", 1), ("b", 2)], []]


def test_parameters():
    assert params.CLUSTERS_PER_TAB == {"TAB_N1": 6, "TAB_N2": 12, "TAB_N3": 18}
    assert [sum(t == tab for t, _, _ in params.SENTIMENT_SEEDS) for tab in params.CLUSTERS_PER_TAB] == [4, 7, 20]
    assert [sum(t == tab for t, _, _ in params.CRITICAL_CLUSTERS) for tab in params.CLUSTERS_PER_TAB] == [2, 2, 7]
    assert (len(params.STOPWORDS), len(params.LEAK_COLUMNS), len(params.NON_MODEL_COLUMNS)) == (24, 6, 28)
    assert params.BOOSTING == {"trees": 100, "rate": 0.1, "depth": 5} and params.SEED == 42
    assert params.DECISION_THRESHOLDS == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
