import zlib
from collections import Counter

import numpy as np

from ticketlens.llm import sharding


def test_matrix_is_exact():
    counts, sizes = [5, 0, 17, 3], sharding.equal_sizes(25, 4)
    matrix = sharding.communication_matrix(counts, sizes, 1)
    assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix)] == sizes
    assert sharding.communication_matrix([], [0, 0], 1) == []


def test_large_populations_have_the_right_mean():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 3_000_000_000, 9_000_000_000, 4_000_000_000) for _ in range(400)]
    sd = np.sqrt(4e9 * 0.25 * 0.75 * (8 / 12))
    assert abs(np.mean(draws) - 1e9) < 5 * sd / np.sqrt(len(draws)) and 0.8 < np.std(draws) / sd < 1.2


def check(docs, n_shards):
    rows = sharding.digest(docs)
    out = sharding.shard(rows, ["doc_id", "size", "text_crc32"], n_shards).collect()
    source = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(j, [])) for j in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(n_shards))
    return {(r.doc_id, r.size, r.text_crc32): (r.shard, r.slot) for r in out}


def test_shards_of_odd_rows(odd_docs):
    check(odd_docs, 24)


def test_whole_table_and_reruns(real_docs):
    assert check(real_docs, 24) == check(real_docs.repartition(7), 24)


def test_seeds_differ_and_spread(real_docs):
    rows = sharding.digest(real_docs)
    a, b = ({r.doc_id: r.shard for r in sharding.shard(rows, ["doc_id"], 4, seed).collect()} for seed in (1, 2))
    assert a != b
    together = Counter((a[i], b[i]) for i in a)
    assert len(together) == 16 and max(together.values()) < 40  # 200 rows in 16 cells


def test_empty_table(no_docs):
    assert sharding.shard(sharding.digest(no_docs), ["doc_id"], 24).count() == 0


def test_write(real_docs, tmp_path, spark):
    rows = sharding.shard(sharding.digest(real_docs), ["doc_id"], 4)
    sharding.write_shards(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == real_docs.count()
