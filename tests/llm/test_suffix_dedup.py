import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketlens.llm import suffix_dedup


def brute(pairs):
    """Marks every byte of a window that was seen before, documents by id."""
    seen, out = set(), {}
    for doc_id, text in sorted(pairs):
        data = (text or "").encode()
        mark = np.zeros(len(data), bool)
        fresh = []
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                mark[i : i + 100] = True
            seen.add(window)
            fresh.append(window)
        left = bytes(b for b, m in zip(data, mark) if not m)
        spans = int((mark & ~np.r_[False, mark[:-1]]).sum()) if len(data) else 0
        out[doc_id] = (len(data), int(mark.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=14).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=9))
def test_suffix_order(strings):
    who, size, prefix = suffix_dedup.suffix_order(strings)
    order = [strings[w][len(strings[w]) - int(n) :] for w, n in zip(who, size)]
    assert order == sorted(order) and len(order) == sum(map(len, strings)) + len(strings)
    for a, b, p in zip(order, order[1:], prefix[1:]):
        assert p == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_all_byte_values():
    strings = [bytes(range(256)), bytes(range(255, -1, -1))[:200]]
    who, size, _ = suffix_dedup.suffix_order([s[:250] for s in strings])
    order = [strings[w][:250][len(strings[w][:250]) - int(n) :] for w, n in zip(who, size)]
    assert order == sorted(order)


@pytest.mark.parametrize("hot", [2000, 3])
def test_equals_brute_force(real_docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    pairs = [(r.doc_id, r.text) for r in real_docs.select("doc_id", "text").collect()]
    assert got(suffix_dedup.deduplicated(real_docs)) == brute(pairs)


def test_odd_rows(unique_docs):
    pairs = [(r.doc_id, r.text) for r in unique_docs.select("doc_id", "text").collect()]
    assert got(suffix_dedup.deduplicated(unique_docs)) == brute(pairs)


def test_repeated_row_null_id_and_spans(odd_docs, no_docs):
    out = suffix_dedup.deduplicated(odd_docs, with_text=True).collect()
    assert len(out) == odd_docs.count() and suffix_dedup.deduplicated(no_docs).count() == 0
    twice = sorted(r.n_removed for r in out if r.doc_id == 3)
    assert twice[1] == max(r.n_bytes for r in out if r.doc_id == 3) and twice[0] < twice[1]
    assert [r.n_removed == r.n_bytes for r in out if r.doc_id is None] == [True]  # comes after all others
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in out:
        if r.doc_id in (0, 11, 14):
            data, at, kept = texts[r.doc_id].encode(), 0, b""
            for s in r.spans:
                kept, at = kept + data[at : s.low], s.high
            assert kept + data[at:] == bytes(r.kept)


def test_periodic_and_overlapping(spark):
    rnd = random.Random(5)
    noise = "".join(rnd.choice("abcdefgh") for _ in range(400))
    texts = [(0, "ab" * 300), (1, noise), (2, noise[37:190] + "x" + noise[150:390]), (3, "ab" * 80 + noise[5:110]), (4, noise[:99]), (5, "z" * 101), (6, noise[:100])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(suffix_dedup.deduplicated(docs)) == brute(texts)


def test_crowded_line_makes_few_windows(spark, monkeypatch):
    """Around a line that very many texts have, only windows whose core is shared are hashed, each once for a batch."""
    rnd = random.Random(7)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    line = noise(130)
    texts = [(i, noise(120) + line + noise(120)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    tables, write = {}, suffix_dedup.written

    def recorded(df, name, *rest):
        tables[name] = write(df, name, *rest)
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "written", recorded)
    assert got(suffix_dedup.deduplicated(docs)) == brute(texts)
    assert tables["hot"].count() > 0
    made = sum(r.n for r in tables["judged"].join(tables["hot"], "h").collect())
    assert 0 < tables["windows"].count() < 0.8 * made


def test_only_shared_stretches_are_ordered():
    """Bytes beside a core that no other part has there are not put in order; the repeats stay the same."""
    rng = random.Random(5)
    shared = rng.randbytes(110)
    before = [rng.randbytes(n) for n in (20, 25, 3)]
    group = [(7, d, d, 1000 * d, False, len(b) + 40, b + shared + rng.randbytes(25)) for d, b in enumerate(before)]
    ranges, families = suffix_dedup._families(group)
    assert not ranges and [len(f) for f in families] == [3]
    assert {part for *_, part in families[0]} == {shared}
    found = suffix_dedup._window_ranges(families[0])
    assert sorted(found) == [(d, d, 1000 * d + len(b), 1000 * d + len(b) + 110) for d, b in enumerate(before) if d]
