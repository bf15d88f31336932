import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ticketlens.llm import mixing, packing
from ticketlens.runtime import written

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizer():
    rnd, tokenizer = random.Random(1), Tokenizer.from_file(PATH)
    letters = "aB'sd \t.\x0bé́Σ1½,!中À\x01\x7f\xa0\x85İ"
    texts = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(1500)]
    texts += ["it's 'S don't we'll'd", "<|endoftext|> a<|endoftext|>b", "a.,;b ,,  .", "ﬁ ſ ǅ", "🙂🙂 a🙂", "", " \n"]
    for text, ids in zip(texts, packing.encode(texts, PATH)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check(docs):
    pieces = [r.asDict() for r in packing.pack(docs, PATH, with_ids=True).collect()]
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0) and p["length"] > 0
        at[p["sequence_id"]] = p["offset"] + p["length"]
        assert p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and len(p["ids"]) == 4 * p["length"]
    n = len(at)
    assert sorted(at) == list(range(n)) and all(at[i] == 4096 for i in range(n - 1)) and (not n or at[n - 1] <= 4096)
    return pieces


def test_round_trip(real_docs):
    pieces, texts = check(real_docs), {r.doc_id: r.text for r in real_docs.collect()}
    found = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert p["start"] == len(found.get(p["doc_id"], b"")) // 4
        found[p["doc_id"]] = found.get(p["doc_id"], b"") + bytes(p["ids"])
    assert {i: np.frombuffer(b, "<u4").tolist() for i, b in found.items()} == {i: plain(t) for i, t in texts.items()}
    assert all(p["doc_tokens"] == len(found[p["doc_id"]]) // 4 for p in pieces)


def test_odd_rows(odd_docs, no_docs):
    pieces = check(odd_docs)
    assert sum(p["length"] for p in pieces) == sum(len(plain(r.text)) for r in odd_docs.collect())
    assert [p["length"] for p in pieces if p["doc_id"] == 4] == [1]
    assert packing.pack(no_docs, PATH).count() == 0


def test_sequences(real_docs):
    pieces = packing.pack(real_docs, PATH, window=64, with_ids=True)
    rows = packing.sequences(pieces, window=64).collect()
    assert all(len(r.ids) == 4 * 64 for r in rows if r.n == 64)
    (last,) = [r for r in rows if r.sequence_id == max(x.sequence_id for x in rows)]
    assert len(last.ids) // 4 in (1, 2, 4, 8, 16, 32, 64) and len(last.ids) // 4 < 2 * last.n or last.n == 1


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    texts = ["a b c d e", "f g h", "a b c"] * 2
    assert [np.frombuffer(b, "<u4").tolist() + [2] for b in packing.encode(texts, PATH)] == [plain(t) for t in texts]


def test_words_met_again_stay(monkeypatch):
    """A full table goes on as the older one; a word in it is not tokenised anew, one of neither table is."""
    monkeypatch.setattr(packing, "WORDS_KEPT", 2)
    words, anew = packing.Words(PATH), []
    monkeypatch.setattr(words, "word", lambda word: anew.append(word) or packing.Words.word(words, word))
    for text in ("a b c", "a d", "e a f", "a", "b"):
        assert np.frombuffer(words.encode(text), "<u4").tolist() + [2] == plain(text)
        assert len(words.known) + len(words.known_before) <= 2 * (2 + 3)
    assert anew == [b"a", b"b", b"c", b"d", b"e", b"f", b"b"]


def test_few_rows_at_a_time(spark, monkeypatch):
    """A worker gets 500 texts at a time, and the second pass runs no Python: both had filled the executors' memory."""

    def counted(df, function, schema):
        def small(batches):
            for batch in batches:
                assert batch.num_rows <= 500
                yield batch

        return real(df, lambda batches: function(small(batches)), schema)

    real = packing.stream_map
    monkeypatch.setattr(packing, "stream_map", counted)
    docs = spark.range(1800).selectExpr("id AS doc_id", "concat('a', id) AS text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pieces = packing.pack(docs, PATH)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert "Arrow" not in pieces._jdf.queryExecution().executedPlan().toString()
    assert pieces.filter("start = 0").count() == 1800


def test_documents_over_many_windows(spark):
    """Pieces that begin anywhere in a block of ids, of documents shorter and far longer than a window."""
    texts = [" ".join(f"{i}a{j}" for j in range(n)) for i, n in enumerate((1, 700, 3, 64, 0, 2000, 15))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for window in (1, 7, 64):
        rows = sorted(packing.pack(docs, PATH, window=window, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.offset + r.length <= window for r in rows)
        assert all(r.sequence_id * window + r.offset == sum(x.length for x in rows[:i]) for i, r in enumerate(rows[:300]))
        assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == [t for text in texts for t in plain(text)]


def positions(pieces, window=4096):
    return {p.doc_id: p.sequence_id * window + p.offset for p in pieces.filter("start = 0").collect()}


def test_order_of_files(spark, tmp_path):
    """Files of very different sizes, dealt to tasks by size and the large ones cut in splits, are packed in the order of the table."""
    path, before = str(tmp_path / "docs"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes = [1, 400, 3, 4000, 50, 2, 900, 10, 2500, 5, 30, 700]
    cuts = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    rows = spark.createDataFrame([(i, " ".join(map(str, range(i, i + 40)))) for i in range(cuts[-1])], "doc_id long, text string")
    for i in range(len(sizes)):  # a job per file: files named by hand as one writer names them
        part = rows.filter(f"doc_id >= {cuts[i]} AND doc_id < {cuts[i + 1]}").coalesce(1).sortWithinPartitions("doc_id")
        part.write.option("parquet.block.size", 65536).parquet(f"{path}-{i}")
        (one,) = (tmp_path / f"docs-{i}").glob("part-*.parquet")
        (tmp_path / "docs").mkdir(exist_ok=True)
        one.rename(tmp_path / "docs" / f"part-{i:05d}-c000.snappy.parquet")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() > 3
        for table in (docs, docs.filter("doc_id <> 7").select("text", "doc_id")):
            at = positions(packing.pack(table, PATH))
            assert len(at) == table.count() and sorted(at, key=at.get) == sorted(at)
        twice = check(spark.read.parquet(path, path))  # each split twice: packed twice, without overlap
        assert sum(p["length"] for p in twice) == 2 * sum(p["length"] for p in check(docs))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_order_of_partitions(spark):
    """A plan that is not a scan is packed in its own order."""
    docs = spark.createDataFrame([(i, f"a{i} b") for i in range(500)], "doc_id long, text string").repartition(7)
    at = positions(packing.pack(docs.orderBy("doc_id"), PATH))
    assert sorted(at, key=at.get) == list(range(500))


def test_curriculum_reaches_the_sequences(spark, real_docs):
    """The mixed table, written to many files and read again, is packed in the order of training positions."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = [r.doc_id for r in mixing.ordered(mixing.mix(mixing.sized(real_docs))).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = written(mixing.mixed_documents(real_docs), "mixed")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        assert len(mixed.inputFiles()) > 3
        pieces = packing.pack(mixed, PATH).filter("start = 0").orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [p.doc_id for p in pieces] == want
