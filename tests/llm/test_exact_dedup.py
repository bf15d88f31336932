import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ticketlens.llm import exact_dedup
from ticketlens.llm.queries import QUERIES


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, sha) per row and the number of kept rows per group."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[norm(text)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr), len(groups)


def check(docs, **options):
    longest = -F.coalesce(F.length("text"), F.lit(0))
    got = exact_dedup.copies(docs, longest, **options).collect()
    want, groups = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)
    return got


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert exact_dedup.copies(no_docs).count() == 0 and exact_dedup.deduplicated(no_docs).count() == 0


def test_real(real_docs):
    check(real_docs)


def test_only_hash_is_shared(real_docs, odd_docs):
    """With a hash of four bits nearly all groups collide; bytes keep them apart."""
    for docs in (real_docs, odd_docs):
        check(docs, content_hash=lambda t: F.substring(F.md5(t.cast("binary")), 1, 1).cast("binary"))
        one = exact_dedup.deduplicated(docs, content_hash=lambda t: F.lit("x").cast("binary"))
        assert one.count() == len({norm(r.text) for r in docs.select("text").collect()})


def test_a_group_of_a_third_of_all_rows(spark):
    texts = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    again = spark.range(6000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("t 5").alias("text"))  # one row repeated
    check(texts.unionByName(again))


def test_default_keeps_the_smallest_id(spark):
    rows = [(3, "a b"), (2, "ab"), (2, "ab"), (9, None), (4, " \n"), (None, "z"), (None, "z ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("other"))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.copies(docs).collect()}
    assert {(3, 2, 3, False), (2, 2, 3, True), (9, 4, 2, False), (4, 4, 2, True), (None, None, 2, True)} <= got
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect())[1:] == [(2, "ab"), (4, " \n")]


def test_deduplicated_is_what_is_kept(odd_docs):
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted(repr(r.doc_id) for r in exact_dedup.copies(odd_docs).collect() if r.kept)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want


def test_no_python_on_the_path(spark, sf_dir, real_docs):
    for frame in (QUERIES["op11_exact_dedup"](spark, sf_dir), exact_dedup.deduplicated(real_docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_spread_join_gives_the_same(spark, real_docs, monkeypatch):
    """The way taken where groups are too many to broadcast."""
    from ticketlens.operators import joins

    plain = joins.lookup_join
    monkeypatch.setattr(exact_dedup, "lookup_join", lambda *a, **b: plain(*a, **b, broadcast_rows=0))
    check(real_docs)
