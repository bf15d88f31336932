"""Explicit schemas. Reads never infer types."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def table_schema(text: str) -> T.StructType:
    """Schema from ``name type, ...``; unlike the DDL function of Spark it needs no running session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_TICKETS = table_schema(
    "ID_CLIENTE bigint, CODIGO bigint, PROTOCOLO bigint, NUMERO_OS bigint, "
    "ULTIMO_CANCELAMENTO timestamp_ntz, SITUACAO string, DATA_REGISTRO timestamp_ntz, CANAL string, "
    "TAB_N1 string, TAB_N2 string, TAB_N3 string, "
    "TICKET_MEDIO double, IDADE_APROX bigint, MESES bigint"
)
EVENTS = table_schema(
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)
DOCUMENTS = table_schema("doc_id bigint, text string, lang string, source string, n_chars bigint")
EMBEDDINGS = table_schema("vec_id bigint, embedding array<float>, label int")
LABELS = table_schema("doc_id bigint, quality int, toxic int")

METRICS = table_schema("dataset string, auc_roc double, precision double, recall double, f1_score double")
SCORED = table_schema("PROTOCOLO bigint, split string, y int, p double")
IMPORTANCES = table_schema("feature string, importance double")
SEEDS = table_schema("tab string, seed_text string, score double")
CRITICAL_CLUSTERS = table_schema("tab string, feature string, label string")
CLUSTER_DICTIONARY = table_schema("tab string, cluster_id int, label string")
IDENTIFYING = table_schema("feature string, values bigint, pairs bigint, mean_customers double, identifying boolean, exact boolean")
