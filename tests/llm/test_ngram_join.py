import re
from collections import defaultdict

import numpy as np
import pytest

from ticketlens.llm import graph, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(pairs, k, percent):
    """doc -> (set size, component, number of links)."""
    sets = {i: shingle_set(t, k) for i, t in pairs}
    root, degree = {i: i for i in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= percent * either:
                degree[i] += 1
                degree[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), degree[i]) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_equals_brute_force(real_docs, k, percent):
    pairs = [(r.doc_id, r.text) for r in real_docs.select("doc_id", "text").collect()]
    assert got(ngram_join.join(real_docs, k, percent)) == brute(pairs, k, percent)


def test_odd_rows(unique_docs):
    pairs = [(r.doc_id, r.text) for r in unique_docs.select("doc_id", "text").collect()]
    found = got(ngram_join.join(unique_docs))
    assert found == brute(pairs, 3, 90)
    assert found[4] == (0, 4, 0) and found[9][1] == 8


def test_null_id_and_repeated_row(odd_docs):
    out = ngram_join.join(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert {r.component_id for r in out if r.doc_id == 3} == {0}


def test_empty_table(no_docs):
    assert ngram_join.join(no_docs).count() == 0


def test_big_family_in_tiles(spark, monkeypatch):
    """Chains of near copies, cut into many tiles."""
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 4)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):
        mine = list(words)
        for j in range(i // 4):
            mine[j] = f"x{j}"
        texts.append((i, " ".join(mine)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(ngram_join.join(docs)) == brute(texts, 3, 90)


def test_bands_cover_all_pairs():
    """Any two sizes that can link share a band whose bound covers their differences."""
    for percent in (80, 90):
        shared = {n: dict(ngram_join.bands(n, percent)) for n in range(1, 400)}
        for a in range(1, 330):
            for b in range(a, a * 100 // percent + 1):
                most = (a + b) - 2 * -(-percent * (a + b) // (100 + percent))
                if b < 400 and most > 0:
                    assert any(shared[a].get(band, -1) >= most for band in shared[b] if band in shared[a]), (a, b, percent)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(0)
    for n in (9, 10, 12, 19, 25, 60, 400):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            swap = max(0, int(n * 0.05))
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 1 << 63, swap).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 190 * both >= 90 * (len(a) + len(b)) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(ngram_join.block_keys(a, 90), ngram_join.block_keys(b, 90)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 1000 + i) for i in range(1, 40)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and found[300] == 100 and found[1020] == 1000


def test_repeated_id_with_two_texts(spark):
    """Both texts of an id keep their links, in whatever order the rows are read."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(1, near), (1, other), (2, near + " tail"), (3, other + " tail")]
    for order in (rows, rows[::-1]):
        found = sorted((r.doc_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect())
        assert found == [(1, 1), (1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("percent,k", [(80, 5), (90, 3)])
def test_small_sets_share_a_key_they_hold(percent, k):
    """Every pair of linked sets of up to 30 n-grams shares a key; sets that only equal ones link have none."""
    rng = np.random.default_rng(1)
    hashes = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for a_size in range(1, 31):
        for b_size in range(a_size, a_size * 100 // percent + 1):
            for _ in range(60):
                most = (a_size + b_size) * (100 - percent) // (100 + percent)
                differ = most - (most - b_size + a_size) % 2
                common = (a_size + b_size - differ) // 2
                if differ < 1 or common < 1 or 100 * common < percent * (common + differ):
                    continue
                both = hashes(common)
                a, b = np.union1d(both, hashes(a_size - common)), np.union1d(both, hashes(b_size - common))
                for parts in (ngram_join.PARTS, None):
                    assert len(np.intersect1d(ngram_join.block_keys(a, percent, parts), ngram_join.block_keys(b, percent, parts)))
    lonely = 3 if percent == 80 else 8
    assert all(len(ngram_join.block_keys(hashes(n), percent)) == 0 for n in range(1, lonely + 1))
    assert len(ngram_join.block_keys(hashes(lonely + 2), percent))


def test_short_texts(spark):
    """Different short texts are not compared with each other, and their links are all found."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(6)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(900)]
    texts += [" ".join(f"x{i}{j}" for j in range(2)) for i in range(600)] + [" ".join(f"y{i}{j}" for j in range(7)) for i in range(300)]
    pairs = list(enumerate(texts))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    for k, percent in ((5, 80), (3, 90), (1, 50)):
        assert got(ngram_join.join(docs, k, percent)) == brute(pairs, k, percent), (k, percent)
    sets = ngram_join.described(docs.filter("doc_id >= 900"), 5, 80)
    assert sets.filter("size(keys) > 0").count() == 0


def test_all_blocks(real_docs):
    pairs = [(r.doc_id, r.text) for r in real_docs.select("doc_id", "text").collect()]
    assert got(ngram_join.join(real_docs, 5, 80, None)) == brute(pairs, 5, 80)
