import importlib.util
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from test_ngram_join import brute as linked
from tokenizers import Tokenizer

from ticketlens.llm import classifier, mixing, secrets
from ticketlens.llm.queries import ORACLES, QUERIES
from ticketlens.runtime import written


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Result of each stage over the small table, as the driver runs them."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_registered(spark):
    import __spark_entry__ as entry

    numbers = sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k.startswith("op") and k[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries() and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "n-gram Jaccard join" and len(corpus_pipeline.STAGES) == 5


def test_columns(steps, real_docs):
    assert all(s.columns == real_docs.columns for s in steps[:-1])


def test_quality_stage(spark, steps, real_docs, sf_dir):
    kept = {r.doc_id for r in steps[0].collect()}
    weights = classifier.fit(real_docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in real_docs.collect():
        at, x = classifier._vector(classifier.features(r.text or ""))
        z = weights[at] @ x
        if abs(z) > 1e-3:
            assert (r.doc_id in kept) == (z > 0)


def test_near_duplicate_stage(steps):
    before = [(r.doc_id, r.text) for r in steps[0].collect()]
    want = {i for i, (_, component, _) in linked(before, 5, 80).items() if i == component}
    assert {r.doc_id for r in steps[1].collect()} == want and len(want) < len(before)


def test_secret_stage(steps):
    automaton = secrets.keyword_automaton()
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[1:3])
    assert set(before) == set(after)
    for i, r in before.items():
        spans = secrets.find_spans(r.text or "", automaton)
        assert (after[i].text == r.text) == (not spans) and after[i].n_chars == len(after[i].text)


def test_mixing_stage(steps):
    plan = {r.doc_id: r.copies for r in mixing.mix(mixing.sized(steps[2])).collect()}
    after = {}
    for r in steps[3].collect():
        after[r.doc_id] = after.get(r.doc_id, 0) + 1
    assert after == {i: n for i, n in plan.items() if n}


def test_packing_stage(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in steps[3].collect())
    assert sum(r.length for r in steps[4].collect()) == want


def test_run_gives_the_last_stage(spark, steps, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == steps[4].columns and out.count() == steps[4].count()


def test_odd_rows_go_through(spark, odd_docs, sf_dir):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() > 0
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, sf_dir)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 3 not in ids and None in ids


def test_empty_table_goes_through(spark, no_docs, sf_dir):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_nothing_else_imports_the_subpackage():
    root = Path(importlib.util.find_spec("ticketlens").origin).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "ticketlens.llm" not in file.read_text(encoding="utf-8"), file
