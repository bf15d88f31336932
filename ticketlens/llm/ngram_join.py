"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Equal sets are one class and are joined as one. Columns of the incidence matrix (n-grams) are dealt by hash into blocks. Two sets of
sizes a and b that reach the similarity differ in at most (a + b)(1 - t)/(1 + t) n-grams, so with more blocks than that some blocks are
equal in both; documents that share an equal block meet in a group, nothing else is compared. In a group the product accumulates
overlap counts block of columns by block, and drops documents all whose pairs can no longer reach the bound that their sizes set.

The number of blocks depends on the size (a band per size for small sets, bands a quarter apart for others; a set near a band's end takes
part in the next one too). A size that only equal sets can link has no block at all. Empty blocks are not compared: a set whose n-grams all
fall into as few blocks as may differ is grouped by its single n-grams instead, so two linked sets share something they hold. Sets with
at most ``PARTS`` blocks use all: no link can be missed. Larger sets use ``PARTS`` of them; each block of a linked pair is equal with
probability e^-0.9 or more, so a link is missed with probability below 1e-8; with ``parts=None`` they use all, and none is missed.

Groups are formed by the least class of each block, so a family of copies makes as many rows as it has members. Big groups are cut into
tiles of two chunks, each pair of members meets in exactly one tile, and a tile returns a spanning forest of its links. Components come
from these. Links are counted exactly: a pair that meets in several groups counts in the first.

Defined results: null text or one without words has an empty set and no link; rows without an id have no link and no component; repeated
rows are one class; ties do not matter. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import ascii_lower, stream_map, texts_of
from ticketlens.llm.common import parts as shuffle_tasks
from ticketlens.llm.graph import components
from ticketlens.runtime import bounded, written

SHINGLE, PERCENT = 3, 90
PARTS = 40
BAND_RATIO, FIRST_BAND = 1.25, 10
#: A chunk of a group holds about so many documents and n-grams; a tile has two.
CHUNK_DOCS, CHUNK_SHINGLES = 128, 200_000
_COLUMNS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all words as one, where there are fewer."""
    words = ascii_lower(text).encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for i in range(min(size, len(w))):
        h = _mix(h * _ODD + w[i : i + n])
    return np.unique(h)


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, most differences) of the bands a set of this size takes part in; bands in which only equal sets link are left out."""
    out, band, low = [], 0, 1
    while True:
        high = low + 1 if low < FIRST_BAND else int(low * BAND_RATIO) + 1  # sizes low to high - 1
        most = int(2 * (high - 1) * (100 - percent) // (100 + percent))
        if size < low and 100 * size < percent * low:  # too small for a partner here and further on
            return out
        if size < high and most:  # also as the smaller of a pair
            out.append((band, most))
        band, low = band + 1, high


def block_keys(hashes: np.ndarray, percent: int, parts: int | None = PARTS) -> np.ndarray:
    """One 64-bit key per block of the set that is used and holds n-grams, or, where these lie in too few blocks, per n-gram."""
    keys = []
    for band, most in bands(len(hashes), percent):
        m = most + 3 + most // 8
        mixed = _mix(hashes)
        block = (mixed >> np.uint64(33)) % np.uint64(m)
        order = np.argsort(block, kind="stable")
        sorted_blocks = block[order]
        starts = np.flatnonzero(np.r_[True, sorted_blocks[1:] != sorted_blocks[:-1]])
        sums = np.add.reduceat(_mix(hashes[order] * _ODD), starts)
        names = sorted_blocks[starts]
        if len(names) <= most:  # all of them may differ from a linked set's
            keys.append(_mix(_mix(hashes * _ODD) + np.uint64(band) + _ODD))
        used = names < (m if parts is None else parts)
        keys.append(_mix(_mix(sums[used] + names[used] * _ODD) + np.uint64(band)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def described(docs: DataFrame, size: int, percent: int, parts: int | None = PARTS) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set; null for the empty one) and keys (of its blocks), from one reading of the texts.

    A task gives the keys of a set once; rows without an id have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, nodes, keys = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                h = shingles(text, size)
                node = set_id(h) if len(h) else None
                n.append(len(h))
                nodes.append(node)
                if node is None or doc_id is None or node in seen:
                    keys.append(None)
                else:
                    seen.add(node)
                    keys.append(block_keys(h, percent, parts).view(np.int64))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "keys"])

    return stream_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, node long, keys array<long>")


def meeting(rows: DataFrame) -> DataFrame:
    """(lead, node) of classes that share a key, from (key, node)."""
    shared = rows.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead < top").drop("top")
    found = rows.join(shared, "key").filter("node <> lead").select("lead", "node").distinct()
    found = written(found, "groups")
    found = found.unionByName(found.select("lead", F.col("lead").alias("node"))).distinct()
    # a lead that is a member elsewhere hands its members on: fewer, larger groups
    moved = found.groupBy("node").agg(F.min("lead").alias("_to")).withColumnRenamed("node", "_lead")
    joined = found.join(moved, F.col("lead") == F.col("_lead")).select(F.col("_to").alias("lead"), "node").distinct()
    return written(joined, "groups")


def _reaches(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 + percent) * inter >= percent * (a + b)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs (row of left, row of right) that reach the similarity; product of the two incidence matrices, block of columns by block."""
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    every, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate([a, b]))
    is_left = owner < len(a)
    in_both = (np.bincount(column[is_left], minlength=len(every)) > 0) & (np.bincount(column[~is_left], minlength=len(every)) > 0)
    number = np.cumsum(in_both) - 1
    use = in_both[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(in_both.sum())
    remaining = np.bincount(owner, minlength=len(a) + len(b))
    overlap = np.zeros((len(a), len(b)), np.int64)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    for at in range(0, width, _COLUMNS):
        most = np.minimum(remaining[rows][:, None], remaining[len(a) + cols][None, :]) + overlap[np.ix_(rows, cols)]
        alive = _reaches(most, a[rows][:, None], b[cols][None, :], percent)
        rows, cols = rows[alive.any(1)], cols[alive.any(0)]
        if not len(rows):
            break
        begin, end = np.searchsorted(column, (at, at + _COLUMNS))
        matrix = np.zeros((len(a) + len(b), min(_COLUMNS, width - at)), np.float32)
        matrix[owner[begin:end], column[begin:end] - at] = 1
        overlap[np.ix_(rows, cols)] += (matrix[rows] @ matrix[len(a) + cols].T).astype(np.int64)
        remaining -= np.bincount(owner[begin:end], minlength=len(remaining))
    return np.argwhere(_reaches(overlap, a[:, None], b[None, :], percent))


def _tile_rows(lead: int, same: bool, rows: list[tuple], percent: int, listed: bool = False) -> list[tuple[int, int, int]]:
    """Rows (a, b, 0): links of a spanning forest; (a, a, n): n documents linked to class a by pairs that count here.

    ``listed``: instead, rows (a, b, common n-grams) of all pairs that count here.
    """
    members = {r[0]: r for r in rows}  # repeated rows of one class fall together
    left = [m for m in members.values() if m[1]]
    right = left if same else [m for m in members.values() if not m[1]]
    if len(left) < 1 or len(right) < 1 or (same and len(left) < 2):
        return []
    root = {m: m for m in members}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, linked = [], {}
    for i, j in overlaps([m[4] for m in left], [m[4] for m in right], percent):
        x, y = left[i], right[j]
        if x[0] == y[0] or (same and i >= j):
            continue
        if listed:
            if min(set(x[3]) & set(y[3])) == lead:
                out.append((x[0], y[0], len(np.intersect1d(x[4], y[4], assume_unique=True))))
            continue
        if min(set(x[3]) & set(y[3])) == lead:
            linked[x[0]] = linked.get(x[0], 0) + y[2]
            linked[y[0]] = linked.get(y[0], 0) + x[2]
        p, q = find(x[0]), find(y[0])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x[0], y[0], 0))
    return out + [(node, node, n) for node, n in linked.items()]


def links(docs: DataFrame, classes: DataFrame, grouped: DataFrame, size: int, percent: int, listed: bool = False) -> DataFrame:
    """(a, b, n) as in ``_tile_rows``, from all tiles. ``classes``: node, rep (a document of it), n_docs, n_shingles."""
    leads = grouped.groupBy("node").agg(F.sort_array(F.collect_list("lead")).alias("leads"))  # at most a lead per block of the set
    members = grouped.join(leads, "node").join(classes, "node")
    size_of = members.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK_DOCS, F.col("s") / CHUNK_SHINGLES)).cast("int")
    cut = bounded(size_of.select("lead", chunks.alias("chunks")).filter("chunks > 1"))  # few groups are cut, so members need not move
    members = members.join(cut, "lead", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node", "lead"), F.col("chunks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = members.select(
        "lead", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "rep", "n_docs", "leads"
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    tiles = tiles.join(texts, F.col("rep") == F.col("_id")).drop("_id", "rep")
    dealt = tiles.repartition(2 * shuffle_tasks(docs.sparkSession), "lead", "i", "j").sortWithinPartitions("lead", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, known = None, [], {}

        def finished() -> pa.RecordBatch:
            found = _tile_rows(key[0], key[1] == key[2], rows, percent, listed) if key is not None else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], ["a", "b", "n"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lead", "i", "j", "chunk", "node", "n_docs", "leads", "text")]
            for lead, i, j, chunk, node, n_docs, its_leads, text in zip(*columns):
                if (lead, i, j) != key:
                    yield finished()
                    if key is None or key[0] != lead or len(known) > 4 * CHUNK_DOCS:
                        known = {}
                    key, rows = (lead, i, j), []
                if node not in known:
                    h = shingles(text or "", size)
                    if set_id(h) != node:  # another row with the same id
                        continue
                    known[node] = h
                rows.append((node, chunk == i, n_docs, its_leads, known[node]))
        yield finished()

    return stream_map(dealt, run, "a long, b long, n long")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, parts: int | None = PARTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (documents it is linked to)."""
    sets = written(described(docs, size, percent, parts), "sets")
    narrow = sets.drop("keys")
    grouped = meeting(sets.select("node", F.explode("keys").alias("key")))  # (lead, node): classes to compare share a lead
    linked = narrow.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = linked.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes, "classes")
    found = written(links(docs, classes, grouped, size, percent), "links")
    roots = components(found.filter("a <> b"))
    degrees = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("degree"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = rooted.join(least, "root").join(degrees, "node", "left")
    labels = written(labels.select(F.col("node").alias("_node"), "component_id", (F.col("n_docs") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")), "labels")
    out = narrow.join(labels, (F.col("node") == F.col("_node")) & F.col("doc_id").isNotNull(), "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
