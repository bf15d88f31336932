import hashlib
import random
from collections import Counter

import numpy as np

from ticketlens.llm import minhash, ngram_join


def word_shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs):
    """docs: (doc_id, text) in order; each with the next one, the last with the first."""
    out = []
    prints = [minhash.digits(minhash.signature(minhash.shingle_hashes(t))) for _, t in docs]
    for i, (doc_id, text) in enumerate(docs):
        j = (i + 1) % len(docs)
        third = len(text) // 3
        edited = text[: len(text) - third] + docs[j][1][:third]
        new = minhash.digits(minhash.signature(minhash.shingle_hashes(edited)))
        row = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i].tobytes().hex(), new.tobytes().hex())
        out.append((*row, minhash.likeness(prints[i], new), minhash.likeness(prints[i], prints[j])))
    return out


def test_whole_table(real_docs):
    docs = sorted(((r.doc_id, r.text or "") for r in real_docs.collect()), reverse=True)
    assert sorted(map(tuple, minhash.fingerprints(real_docs).collect())) == sorted(brute(docs))


def test_odd_rows(odd_docs, no_docs):
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    known = sorted((x for x in texts if x[0] is not None), reverse=True) + [x for x in texts if x[0] is None]
    assert Counter(map(tuple, minhash.fingerprints(odd_docs).collect())) == Counter(brute(known))
    assert minhash.fingerprints(no_docs).count() == 0


def test_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert list(map(tuple, minhash.fingerprints(docs).collect())) == brute([(1, "a b c d e f")])


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        estimates = []
        for _ in range(20):
            both = rng.integers(0, 1 << 32, 600).astype(np.uint32)
            n = int(600 * share)
            a = np.concatenate([both[:n], rng.integers(0, 1 << 32, 600 - n).astype(np.uint32)])
            b = np.concatenate([both[:n], rng.integers(0, 1 << 32, 600 - n).astype(np.uint32)])
            estimates.append(minhash.likeness(minhash.digits(minhash.signature(np.unique(a))), minhash.digits(minhash.signature(np.unique(b)))))
        assert abs(np.mean(estimates) - n / (1200 - n)) < 0.03


def test_near_duplicates(real_docs):
    """Every pair is right, and every document with a near copy is in one."""
    sets = {r.doc_id: word_shingles(r.text) for r in real_docs.collect()}
    found = minhash.near_duplicates(real_docs).collect()
    linked = {i for r in found for i in (r.doc_id, r.leader)}
    for r in found:
        a, b = sets[r.doc_id], sets[r.leader]
        assert abs(r.jaccard - len(a & b) / len(a | b)) < 1e-9 and r.jaccard >= 0.8
    ids = sorted(sets)
    near = {(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if sets[i] and len(sets[i] & sets[j]) >= 0.95 * len(sets[i] | sets[j])}
    assert near and sum(i in linked and j in linked for i, j in near) >= 0.9 * len(near)


def chain_family():
    """Each text differs in some words from the one before: neighbours are near, the ends are not; some copies; and boilerplate."""
    rnd, words = random.Random(3), [f"w{i}" for i in range(400)]
    texts = []
    for step in range(24):
        texts.append(" ".join(words))
        for _ in range(2):
            words[rnd.randrange(400)] = f"x{step}{rnd.random()}"
    common = " ".join(f"b{i}" for i in range(120))
    texts += [f"{common} " + " ".join(f"t{n}_{i}" for i in range(20 + n)) for n in range(20)] + [texts[5], texts[5].upper()]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


def near_pairs(docs):
    sets = {i: word_shingles(t) for i, t in docs}
    return {(i, j) for i in sets for j in sets if i != j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}


def test_every_near_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 5)
    docs = chain_family()
    want, frame = near_pairs(docs), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert len(want) < len(docs) ** 2 / 2 and any((i, k) not in want for i, j in want for j2, k in want if j == j2 and i != k)
    counts = {r.doc_id: r.n_near for r in minhash.with_near(frame).collect()}
    assert counts == {i: sum(a == i for a, _ in want) for i, _ in docs}
    least = {frozenset(word_shingles(t)): min(i for i, u in docs if word_shingles(u) == word_shingles(t)) for _, t in docs}
    rep = {i: least[frozenset(word_shingles(t))] for i, t in docs}
    listed = sorted((r.doc_id, r.leader) for r in minhash.near_duplicates(frame).collect())
    assert listed == sorted({(i, j) for i, j in want if rep[i] == i > j == rep[j]} | {(i, rep[i]) for i in rep if rep[i] != i})


def test_near_counts_of_odd_rows(odd_docs, no_docs):
    found = {}
    for r in minhash.with_near(odd_docs).collect():
        found.setdefault(r.doc_id, []).append(r.n_near)
    assert found[0] == found[1] == found[2] == [4] and found[3] == [4, 4]  # 0, 1, 2 and both rows of 3
    assert found[None] == found[4] == found[5] == [0] and minhash.with_near(no_docs).count() == 0


def test_text_without_words_is_like_its_kind_only():
    empty = minhash.digits(minhash.signature(minhash.shingle_hashes(" \n")))
    assert minhash.likeness(empty, empty) == 1.0
    for i in range(200):
        other = minhash.digits(minhash.signature(minhash.shingle_hashes(f"some words of text {i}")))
        assert minhash.likeness(empty, other) == minhash.likeness(other, empty) == 0.0
        assert minhash.likeness(other, other) == 1.0
