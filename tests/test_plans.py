"""Physical plans: what must and must not be in them."""

import pytest

from ticketlens import fixtures as X
from ticketlens.catalog.rows import features
from ticketlens.catalog.text import top_terms
from ticketlens.operators import metrics as M
from ticketlens.operators.features import build_features
from ticketlens.runtime import pinned

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_narrow_jvm_stage(spark):
    text = plan(features(spark, SF_DIR))
    assert "Exchange" not in text and "Python" not in text
    # every operator is in the one code generation span
    assert all("*(1)" in line for line in text.strip().splitlines() if "ColumnarToRow" not in line and "Scan" not in line)


def test_generated_code_is_small_enough_to_be_compiled(spark):
    """The JVM leaves methods above 8000 bytes to the interpreter."""
    from ticketlens.operators.training import feature_matrix

    enriched = pinned(X.split_semantic(spark, SF_DIR))
    stages = feature_matrix(build_features(enriched))._jdf.queryExecution().debug().codegenToSeq().iterator()
    sizes = []
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    assert sizes and max(sizes) < 8000


def test_scan_reads_only_what_is_asked(spark):
    df = features(spark, SF_DIR).select("PROTOCOLO", "flag_bloqueado")
    read = [line for line in plan(df).splitlines() if "ReadSchema" in line]
    assert len(read) == 1 and "event_id" in read[0] and "props" not in read[0] and "value" not in read[0]


def test_filter_reaches_the_scan(spark):
    text = plan(X.tickets(spark, SF_DIR).filter("ID_CLIENTE = 7"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in text


def test_split_moves_no_row(spark):
    text = plan(X.split_semantic(spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "rangepartitioning" not in text


def test_top_terms_are_limited_before_the_shuffle(spark):
    text = plan(top_terms(spark, SF_DIR))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("query", [M.roc_auc, M.threshold_sweep, lambda s: M.metrics_table(s, 0.5)])
def test_metrics_have_no_cross_join_or_single_task_sort(spark, query):
    text = plan(query(X.scored(spark, SF_DIR)))
    assert "Cartesian" not in text and "NestedLoop" not in text and "SinglePartition" not in text.split("Subquery")[0]
