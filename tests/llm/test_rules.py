import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + s for i, g in enumerate(grams) if counts[g] > 1 for s in range(3)}
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_counts(real_docs, odd_docs):
    for docs in (real_docs, odd_docs):
        want = Counter((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in rules.text_statistics(docs).select("doc_id", *rules.COUNTS).collect()) == want


def test_learns_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    learned = rules.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in learned:
        hit |= rules._covers(rule, x, 3000)
    assert learned and (hit == bad).mean() > 0.98
    assert "a > 0." in " ".join(rules.describe(learned))


def test_noise_gives_no_rule():
    rng = np.random.default_rng(1)
    assert rules.learn({"a": rng.random(2000)}, rng.random(2000) < 0.1) == []
    assert rules.learn({"a": np.array([])}, np.array([], bool)) == []


def test_held_out_agreement(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    statistics = rules.text_statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).cache()
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    learned = rules.fit(statistics, labels.filter(~held))
    out = rules.judged(statistics, learned).join(labels, "doc_id").filter(held)
    right, n = out.filter("NOT base_failed").agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 500 and right / n > 0.97
    statistics.unpersist()


def test_without_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.fit(rules.text_statistics(odd_docs), labels) == []
    out = rules.judged(rules.text_statistics(odd_docs), []).collect()
    assert len(out) == odd_docs.count() and all(r.kept == (not r.base_failed) for r in out)
    assert all(r.base_failed for r in out if r.doc_id in (4, 5, 6))
    assert rules.text_statistics(no_docs).count() == 0
