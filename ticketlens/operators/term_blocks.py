"""Texts in blocks: how keyword weights are counted inside tasks, on numbers in place of terms.

A block is an Arrow table of some thousand texts whose words are numbered, so its terms (words and pairs of neighbours) are whole numbers
that one sort puts together. Between blocks a term goes by 64 bits of its words' and group's hashes, in a bucket that another 64 bits choose;
terms become text again only for the scores. Words are those of ``functions.text.tokens``; characters that Python's Unicode tables know and
the JVM's older ones don't are letters here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from ticketlens import params

#: Words and texts of a block at most (a text of more words is a block of its own): 2 * 21 + 16 bits tell a term of a text apart.
BLOCK_WORDS = 1 << 21
BLOCK_TEXTS = 1 << 16
#: Bytes of texts that are taken apart at once, one text at least.
PIECE_BYTES = 4 << 20
#: Terms of blocks that a bucket holds, about.
BUCKET_TERMS = 1 << 21
MOST_BUCKETS = 1 << 15

BLOCK_SCHEMA = "block long, words long, bytes long, body binary"
#: ``values`` of a bucket's terms: what a block sends of them with their ``keys``, and what it gets back, in the same order.
SENT_SCHEMA = "block long, bucket int, keys binary, values binary"
GIVEN_SCHEMA = "block long, bucket int, values binary"
LENGTH_SCHEMA = "block long, squares binary, df binary"
_KEYS = ("a-term-of-blocks", "b-term-of-blocks")  # 16 bytes each
_C = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_NONE = np.uint64(0x632BE59BD9B4E019)  # stands for the second word of a single word


@cache
def _letters() -> np.ndarray:
    """Whether a character is a letter, a number or _, for all code points."""
    return np.array([chr(c).isalnum() or c == ord("_") for c in range(0x110000)])


def words_of(texts: pa.Array) -> pa.Array:
    """The lower-case words of two or more characters of each text, all texts at once on their code points."""
    lower = [t.lower() if t else "" for t in texts.to_pylist()]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le"), np.uint32)
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = _letters()[points]
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    begin, end = edges[::2], edges[1::2]
    letter = letter[1:-1]
    letter[begin[end - begin == 1]] = False
    begin, end = begin[end - begin > 1], end[end - begin > 1]
    kept = points[letter]
    utf8 = kept.tobytes().decode("utf-32-le").encode()
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    if len(utf8) != len(kept):
        width = 1 + (kept > 0x7F).astype(np.int8) + (kept > 0x7FF) + (kept > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(width)])[ends]
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(utf8))
    stops = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in lower]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), words)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of PIECE_BYTES, with words in place of texts."""
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
            piece, start = batch.slice(start, stop - start), stop
            yield piece.set_column(piece.schema.get_field_index("text"), "words", words_of(piece.column("text")))


def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_SCHEMA from batches with columns ``text``, ``n``, ``rows`` and those of the groups."""
    held: list[pa.RecordBatch] = []
    words = texts = number = 0
    task = TaskContext.get().partitionId() << 32
    for batch in _pieces(batches):
        sizes, start = np.diff(batch.column("words").offsets.to_numpy()), 0
        while start < len(sizes):
            fitting = int(np.searchsorted(np.cumsum(sizes[start:]), BLOCK_WORDS - words, side="right"))
            fitting = min(fitting, BLOCK_TEXTS - texts)
            if not fitting and held:
                yield from _block(task + number, held)
                held, words, texts, number = [], 0, 0, number + 1
                continue
            stop = start + max(1, fitting)
            held.append(batch.slice(start, stop - start))
            words, texts, start = words + int(sizes[start:stop].sum()), texts + stop - start, stop
    if held:
        yield from _block(task + number, held)


def _block(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that have words, these numbered and without stopwords."""
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column("words").chunk(0)
    flat = lists.flatten().dictionary_encode()
    stop = pc.is_in(flat.dictionary, pa.array(params.STOPWORDS)).to_numpy(zero_copy_only=False)
    ids = flat.indices.to_numpy(zero_copy_only=False)
    kept = ~stop[ids]
    before = np.concatenate([[0], np.cumsum(kept)])
    sizes = np.diff(before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])])
    if not sizes.any():
        return
    words = flat.dictionary.filter(pa.array(~stop))
    numbered = pa.DictionaryArray.from_arrays(pa.array((np.cumsum(~stop) - 1)[ids[kept]].astype(np.int32)), words)
    table = table.drop_columns("words").filter(pa.array(sizes > 0))
    ends = np.concatenate([[0], np.cumsum(sizes[sizes > 0])]).astype(np.int32)
    table = table.append_column("words", pa.ListArray.from_arrays(pa.array(ends), numbered)).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table.to_batches()[0])
    long = pc.binary_length(words).to_numpy()[numbered.indices.to_numpy()].sum()
    columns = [pa.array([v], t) for v, t in ((number, pa.int64()), (len(numbered), pa.int64()), (int(long), pa.int64()), (sink.getvalue().to_pybytes(), pa.binary()))]
    yield pa.record_batch(columns, names=["block", "words", "bytes", "body"])


@dataclass
class Terms:
    """The terms of a slice in a block, in order. Arrays by text have them in the order of their groups."""

    table: pa.Table
    words: pa.Array
    groups: np.ndarray  # a text of each group
    n: np.ndarray  # rows of each text
    rows: np.ndarray  # rows of each group, in all blocks
    text: np.ndarray  # of each use of a term in a text
    tf: np.ndarray
    begin: np.ndarray  # each term's first use
    first: np.ndarray  # words and group of each term
    second: np.ndarray
    group: np.ndarray
    hashes: tuple[np.ndarray, ...]  # of each term, as many as asked for; the last one chooses the bucket

    def of_terms(self, values: np.ndarray) -> np.ndarray:
        """A term's value for each of its uses."""
        return np.repeat(values, np.diff(np.append(self.begin, len(self.text))))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """The sum over each term's uses."""
        return np.add.reduceat(values, self.begin) if len(self.begin) else values

    def df(self) -> np.ndarray:
        """Rows of this block that have the term."""
        return self.summed(self.n[self.text])

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log((1 + self.rows[self.group]) / (1 + df)) + 1

    def by_bucket(self, buckets: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The terms (those where ``some``) in the order of their buckets, and each bucket's number of them."""
        bucket = (((self.hashes[-1] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        if some is not None:
            order = order[some[order]]
        return order, np.bincount(bucket[order], minlength=buckets)


def _mixed(first: np.ndarray, second: np.ndarray, group: np.ndarray) -> np.ndarray:
    """One hash of three; the arrays are used up."""
    first *= _C[0]
    second ^= second >> np.uint64(31)
    second *= _C[1]
    first += second
    first += group
    first ^= first >> np.uint64(29)
    first *= _C[2]
    first ^= first >> np.uint64(32)
    return first


def read_terms(body: bytes, group: Sequence[str], slices: int, part: int, hashes: int = 1) -> Terms:
    """The terms of a block whose first word is in the slice ``part``."""
    table = pa.ipc.open_stream(body).read_all()
    lists = table.column("words").chunk(0)
    flat = lists.flatten()
    ids, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    numbers: dict[tuple, int] = {}
    codes = np.array([numbers.setdefault(g, len(numbers)) for g in zip(*[table.column(c).to_pylist() for c in group])], np.int64)
    order = np.argsort(codes, kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    of_text = codes[order]
    one = np.empty(len(numbers), np.int64)
    one[codes] = np.arange(len(codes))
    digests = [hashlib.md5(repr(g).encode("utf-8", "surrogatepass")).digest() for g in numbers]
    rows = table.column("rows").to_numpy().astype(float)[one]

    plain = words.to_numpy(zero_copy_only=False)
    hashed = [np.append(pd.util.hash_array(plain, hash_key=key, categorize=False), _NONE) for key in _KEYS[-hashes:]]
    begins = ((hashed[-1][:-1] >> np.uint64(8)) % np.uint64(slices) == np.uint64(part))[ids]
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths) - 1] = True  # no text is without words

    word_bits, text_bits = len(words).bit_length(), (len(codes) - 1).bit_length()
    text = np.repeat(place, lengths)
    single = np.flatnonzero(begins)
    pair = np.flatnonzero(begins & ~last)
    uses = np.concatenate(
        [
            (ids[single] << (word_bits + text_bits)) | text[single],
            (((ids[pair] << word_bits) | (ids[pair + 1] + 1)) << text_bits) | text[pair],
        ]
    )
    uses.sort()
    at = _starts(uses)
    tf = np.diff(np.append(at, len(uses)))
    text, term = uses[at] & ((1 << text_bits) - 1), uses[at] >> text_bits
    del uses
    own = of_text[text]
    begin = _starts(term, own)
    term, own = term[begin], own[begin]
    first, second = term >> word_bits, (term & ((1 << word_bits) - 1)) - 1
    seeds = np.array([[int.from_bytes(d[8 * i : 8 * i + 8], "little") for i in (0, 1)] for d in digests], np.uint64)[:, -hashes:]
    mixed = tuple(_mixed(h[first], h[second], seeds[own, i]) for i, h in enumerate(hashed))  # a single word's second is the last one
    return Terms(table, words, one, table.column("n").to_numpy()[order], rows, text, tf, begin, first, second, own, mixed)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the first of equal neighbours stand."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        changed |= column[1:] != column[:-1]
    return np.flatnonzero(np.concatenate([[True], changed]))


def pack(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array: the next ``sizes[i]`` values of 8 bytes each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpack(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column that ``pack`` made, and each row's number of them."""
    sizes = pc.binary_length(column).to_numpy() // 8
    return np.frombuffer(b"".join(v.as_buffer() for v in column), kind), sizes


def send(block: int, terms: Terms, values: np.ndarray, buckets: int, some: np.ndarray | None = None) -> pa.Table:
    """A row of SENT_SCHEMA for each bucket: its terms' keys and values."""
    order, sizes = terms.by_bucket(buckets, some)
    used = np.flatnonzero(sizes)
    sent = (pack(terms.hashes[0][order], sizes[used]), pack(values[order], sizes[used]))
    return pa.table([pa.array(np.full(len(used), block)), pa.array(used.astype(np.int32)), *sent], names=["block", "bucket", "keys", "values"])


def given(found: pa.Table) -> np.ndarray:
    """What a block got back, in the order it sent."""
    return unpack(found.sort_by("bucket").column("values"), np.int64)[0]


def _met(bucket: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts equal keys together, where each begins, their summed values, and the sizes of the rows."""
    (keys, sizes), (values, _) = unpack(bucket.column("keys"), np.uint64), unpack(bucket.column("values"), kind)
    order = np.argsort(keys)
    begin = _starts(keys[order])
    return order, begin, np.add.reduceat(values[order], begin), sizes


def _back(bucket: pa.Table, values: np.ndarray, sizes: np.ndarray) -> pa.Table:
    return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "values": pack(values, sizes)})


def total_rows(bucket: pa.Table) -> pa.Table:
    """How many rows of all blocks have each term."""
    order, begin, summed, sizes = _met(bucket, np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(summed, np.diff(np.append(begin, len(order))))
    return _back(bucket, out, sizes)


def total_scores(bucket: pa.Table) -> pa.Table:
    """Each term's score, for one of the blocks that have it; -1 for the others."""
    order, begin, summed, sizes = _met(bucket, float)
    out = np.full(len(order), -1.0)
    out[order[begin]] = summed
    return _back(bucket, out, sizes)


def lengths(block: int, terms: Terms, found: pa.Table, buckets: int) -> pa.Table:
    """Each text's sum of squared weights over the slice's terms, and the terms' rows in all blocks, in the terms' order."""
    order, _ = terms.by_bucket(buckets)
    df = np.empty(len(order), np.int64)
    df[order] = given(found)  # as many, or this fails
    weights = terms.tf * terms.of_terms(terms.idf(df))
    squares = np.bincount(terms.text, weights * weights, len(terms.n))
    return pa.table({"block": pa.array([block], pa.int64()), "squares": pack(squares, np.array([len(squares)])), "df": pack(df, np.array([len(df)]))})


def shares(terms: Terms, squares: pa.ChunkedArray, df: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The block's share of each term's score, and whether other blocks have the term too. ``squares`` are those of all slices."""
    (values, sizes), (df, _) = unpack(squares, float), unpack(df, np.int64)
    norms = np.sqrt(values.reshape(len(sizes), -1).sum(axis=0))
    share = terms.summed(terms.n[terms.text] * terms.tf / norms[terms.text])
    return share * terms.idf(df) / terms.rows[terms.group], terms.df() != df


def scored(body: bytes, group: Sequence[str], found: pa.Table, slices: int, buckets: int, best: int | None) -> pa.Table:
    """Groups, terms and scores of the terms that are this block's to tell; of each group all that can be among its ``best``, if given."""
    part = found.column("part").to_numpy()
    squares = found.column("squares").drop_null()
    return pa.concat_tables([_scored(read_terms(body, group, slices, i), group, squares, found.filter(part == i), buckets, best) for i in range(slices)])


def _scored(terms: Terms, group: Sequence[str], squares: pa.ChunkedArray, found: pa.Table, buckets: int, best: int | None) -> pa.Table:
    score, split = shares(terms, squares, found.column("df").drop_null())
    order, _ = terms.by_bucket(buckets, split)
    score[order] = given(found.filter(pc.is_valid(found.column("values")))).view(float)  # as many, or this fails
    told = np.flatnonzero(~(score < 0))
    told = told if best is None else told[_leading(score[told], terms.group[told], best)]
    second = terms.second[told]
    words = [terms.words.take(pa.array(terms.first[told])), terms.words.take(pa.array(second, mask=second < 0))]
    own = pa.array(terms.groups[terms.group[told]])
    columns = {c: terms.table.column(c).take(own) for c in group} | {"term": pc.binary_join_element_wise(*words, " ", null_handling="skip")}
    return pa.table(columns | {"score": pa.array(score[told], mask=np.isnan(score[told]))})


def _leading(score: np.ndarray, group: np.ndarray, best: int) -> np.ndarray:
    """Which scores are among the ``best`` highest of their group, or so near to these that nine digits don't tell."""
    kept = [np.zeros(0, np.int64)]
    order = np.argsort(group, kind="stable")
    for own in np.split(order, _starts(group[order])[1:]):
        least = np.partition(score[own], -best)[-best] if len(own) > best else -1.0
        kept.append(own[~(score[own] < least * (1 - 1e-7))])
    return np.concatenate(kept)
