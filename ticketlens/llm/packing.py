"""Packing: concatenate all documents' tokens and cut the stream into fixed windows.

First pass: every task tokenises its documents and writes ids with the token offset inside its part. The parts' totals, added up in the
order of the table, give each part's global offset; a document's global offset is the sum of the two. Second pass: each document is cut at the
window borders that its range crosses, a record per piece, by DataFrame functions. Ids are stored in blocks of a window's length, so a piece
lies in two blocks at most, however long its document. No text or token is shuffled, and there is no padding but in the last window.

The stream has the order of the table. A scan deals splits of files to tasks by size, so there a part is a run of rows of one split, and
parts go by file (Spark's numbered names) and start of the split in it; of any other plan a part is a partition, in their order.

Words between white space are tokenised one by one and remembered by each worker (two bounded tables: a full one is kept as the older one,
words met again move to the newer one), which gives the same ids as tokenising whole texts, because the tokenizer never joins across white space.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import stream_map, texts_of
from ticketlens.runtime import settings, written

WINDOW = 4096
END_ID = 2
#: Words, and pieces of words, in a worker's newer table; then that becomes the older one, so twice as many are remembered at most.
WORDS_KEPT = 300_000
#: Rows a worker gets at a time, so that neither it nor the JVM holds many texts.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Latin-1 without its two white space characters.
SIMPLE_RE = regex.compile(r"[\x21-\x7e\xa1-\xff]+")

_loaded: dict[str, "Words"] = {}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words:
    """A tokenizer that remembers words.

    A new word is normalised, split and given to the tokenizer's own model piece by piece where that is simple: Latin-1 letters, which
    normalisation only lower-cases, and a tokenizer built as NFC, one space for white space, lower case, split by pattern, byte level.
    All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.known_before: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pieces_before: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        normal = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        split = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        simple = normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in split] == ["Split", "ByteLevel"] and split[0]["invert"]
        self.split = regex.compile(split[0]["pattern"]["Regex"]) if simple else None
        cases = self.split.pattern.split("|") if simple else []  # a word of letters is one piece if only suffixes behind "'" go before
        self.letters_whole = r"[\p{L}]+" in cases and all(c.startswith("'") for c in cases[: cases.index(r"[\p{L}]+")])
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = (b for b in range(256) if b not in set(printable))
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}  # byte level: a visible letter per byte

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces_before.get(piece)
            if ids is None:
                plain = piece.isascii() and piece.isalpha()
                shown = piece if plain else piece.encode("utf-8").decode("latin-1").translate(self.letters)
                ids = _bytes([t.id for t in self.model.tokenize(shown)])
            self.pieces[piece] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if self.split is not None and (text.isascii() or SIMPLE_RE.fullmatch(text)) and "<|" not in text:
            if self.letters_whole and text.isalpha():
                return self.piece(text.lower())
            return b"".join(map(self.piece, self.split.findall(text.lower())))
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        words = text.encode("utf-8").split()
        known, before = self.known, self.known_before
        ids = list(map(known.get, words))
        if None in ids:
            for i, (word, found) in enumerate(zip(words, ids)):
                if found is None:
                    if word not in known:
                        known[word] = before[word] if word in before else self.word(word)
                    ids[i] = known[word]
        out = b"".join(ids)
        if len(known) > WORDS_KEPT:
            self.known, self.known_before = {}, known
        if len(self.pieces) > WORDS_KEPT:
            self.pieces, self.pieces_before = {}, self.pieces
        return out


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text, without special tokens, as little-endian unsigned 32-bit integers."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return [_loaded[path].encode(text) for text in texts]


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan is one scan of files with nothing but projections and filters on it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation") and "_metadata" in [a.name() for a in _attributes(plan.metadataOutput())]


def _attributes(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, block: int = WINDOW) -> DataFrame:
    """Written table: file and start of the split, part, place in the part, first token's offset in the part, doc_id, number of tokens, ids
    (32-bit, little-endian) in blocks of ``block`` tokens. ``part`` is the partition's number times 2^32 and the number of the run in it."""
    stored = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if _is_scan(docs) else (F.lit(""), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long"), "text", stored[0].alias("file"), stored[1].cast("long").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, offset, end = (TaskContext.get().partitionId() << 32) - 1, 0, 0, _bytes([end_id])
        last, size = None, 4 * block
        for batch in batches:
            texts = texts_of(batch)
            splits = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
            borders = [i for i in range(1, len(texts)) if splits[i] != splits[i - 1]]
            for begin, stop in zip([0, *borders], [*borders, len(texts)]):
                if begin == stop:
                    continue
                if splits[begin] != last:
                    part, place, offset, last = part + 1, 0, 0, splits[begin]
                for at in range(begin, stop, BATCH_ROWS):  # keeps the ids of a batch small in memory
                    rows = batch.slice(at, min(BATCH_ROWS, stop - at))
                    ids = [a + end for a in encode(texts[at : at + rows.num_rows], path)]
                    n = np.array([len(b) // 4 for b in ids], np.int64)
                    starts = offset + np.cumsum(n) - n
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("file"),
                            rows.column("block"),
                            pa.array(np.full(len(ids), part, np.int64)),
                            pa.array(np.arange(place, place + len(ids), dtype=np.int64)),
                            pa.array(starts),
                            rows.column("doc_id"),
                            pa.array(n),
                            pa.array([[b] if len(b) <= size else [b[i : i + size] for i in range(0, len(b), size)] for b in ids], pa.list_(pa.binary())),
                        ],
                        ["file", "block", "part", "place", "local_start", "doc_id", "doc_tokens", "ids"],
                    )
                    place, offset = place + len(ids), offset + int(n.sum())

    schema = "file string, block long, part long, place long, local_start long, doc_id long, doc_tokens long, ids array<binary>"
    with settings(docs.sparkSession, **{_BATCH: str(BATCH_ROWS)}):
        return written(stream_map(rows, run, schema), "tokens")


def offsets(tokens: DataFrame) -> DataFrame:
    """One row per part: tokens of all parts before it. The window runs over one row per part. Names with more digits come later."""
    totals = tokens.groupBy("file", "block", "part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy(F.length("file"), "file", "block", "part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: document, its start and length there, checksum (and ids), sequence and offset in it."""
    tokens = tokenised(docs, path, end_id, window)
    placed = tokens.join(F.broadcast(offsets(tokens)), F.col("part") == F.col("_part"))  # one row per part
    placed = placed.select("doc_id", "doc_tokens", (F.col("part_start") + F.col("local_start")).alias("at"), "ids")
    crossed = F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + doc_tokens - 1) div {window}"))
    pieces = placed.withColumn("sequence_id", F.explode(crossed))
    begin = F.col("sequence_id") * window - F.col("at")
    pieces = pieces.withColumn("start", F.greatest(F.lit(0), begin)).withColumn("offset", F.col("start") - begin)
    pieces = pieces.withColumn("length", F.least(F.col("doc_tokens"), begin + window) - F.col("start"))
    block, size = F.expr(f"int(start div {window})"), (4 * F.col("length")).cast("int")
    head = F.substring(F.get("ids", block), (4 * (F.col("start") % window) + 1).cast("int"), size)
    tail = F.substring(F.coalesce(F.get("ids", block + 1), F.lit(b"")), F.lit(1), size - F.octet_length(head))
    piece = F.concat(head, tail)
    columns = ["doc_id", "start", "length", F.crc32(piece).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*columns, *([piece.alias("ids")] if with_ids else []))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: every sequence has ``window`` tokens, the last is padded to the next power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n"))
    size = F.least(F.lit(window), F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
    padding = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), size - F.col("n"))), F.lit(b""), lambda a, _: F.concat(a, pad))
    return whole.select("sequence_id", "n", F.when(size > F.col("n"), F.concat(joined, padding)).otherwise(joined).alias("ids"))
