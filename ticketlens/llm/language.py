"""Language identification by compression.

For each language a raw-content dictionary is cut from labelled training texts. A text is compressed, block by block, once with each
dictionary; the language whose dictionary leaves the fewest bytes wins. Where the runner-up is within ``MARGIN`` the guess is rejected.

The dictionaries come from a bounded sample: ``TEXTS_PER_LANGUAGE`` different training texts of each language, lowest hash first, one
slice of ``SLICE`` bytes at a place their hash decides. Their size is ``DICTIONARY_BYTES`` at most. Whole texts are classified.

Defined results: null text or one without a letter is ``und`` with score 0 and rejected; without any training text all are ``und``; ties
go to the first language by name; equal texts get equal results.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import arrow_map, table, texts_of
from ticketlens.llm.labelled import crc_of_id
from ticketlens.runtime import written

TEXTS_PER_LANGUAGE = 128
SLICE = 1024
DICTIONARY_BYTES = 128 * 1024
#: Bytes compressed at once; a dictionary tells less the more text of its own a block has.
BLOCK = 2048
LEVEL = 6
#: A guess is rejected when the runner-up needs less than this share of bytes more.
MARGIN = 0.02
UNDETERMINED = "und"


def training_slices(docs: DataFrame, keep: Column) -> dict[str, bytes]:
    """Dictionary content per language, from rows where ``keep`` holds."""
    rows = docs.select("doc_id", "lang", "text").filter(keep & F.col("lang").isNotNull() & (F.length("text") > 0))
    keyed = rows.select(F.col("doc_id").alias("_id"), "lang", F.md5("text").alias("key"))
    different = keyed.groupBy("lang", "key").agg(F.min("_id").alias("_id"))
    # the lowest of each language in two steps, so that no task gets the candidates of all tasks for a frequent language
    chosen = different.withColumn("_b", F.substring("key", 31, 2))
    for by in (("lang", "_b"), ("lang",)):
        first = Window.partitionBy(*by).orderBy("key")
        chosen = chosen.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= TEXTS_PER_LANGUAGE)
    chosen = written(chosen.select("_id", F.col("lang").alias("_lang"), "key"), "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.md5("text") == F.col("key"))
    data = F.encode("text", "utf-8")
    free = F.greatest(F.lit(1), F.octet_length("text") - SLICE)
    begin = F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), free) + 1
    texts = rows.join(F.broadcast(chosen), same).select("lang", "key", F.substring(data, begin.cast("int"), F.lit(SLICE)).alias("slice")).distinct()
    slices: dict[str, list[bytes]] = {}
    for row in texts.orderBy("lang", "key").collect():  # TEXTS_PER_LANGUAGE x SLICE bytes per language
        slices.setdefault(row["lang"], []).append(bytes(row["slice"]))
    return {lang: b"".join(parts)[:DICTIONARY_BYTES] for lang, parts in sorted(slices.items())}


class Guesser:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        for lang, content in dictionaries.items():
            data = zstandard.ZstdCompressionDict(content.lower(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.coders.append((lang, coder))

    def sizes(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass").lower()  # A-Z only
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for _, coder in self.coders]

    def guess(self, text: str) -> tuple[str, float, bool]:
        """Language, score (the larger the margin the nearer to 1), rejected."""
        if not self.coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.coders[0][0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(1, sizes[best])
        return self.coders[best][0], round(margin / (margin + MARGIN), 6) if margin else 0.0, margin < MARGIN


_guessers: dict[str, Guesser] = {}


def guesser(dictionaries: dict[str, bytes]) -> Guesser:
    """The coders of this worker for these dictionaries."""
    key = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).hexdigest()
    if key not in _guessers:
        _guessers.clear()
        _guessers[key] = Guesser(dictionaries)
    return _guessers[key]


def identified(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = guesser(shared.value)
        lang, score, rejected = zip(*map(known.guess, texts_of(batch))) if batch.num_rows else ((), (), ())
        new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(5)) == 0


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = training_slices(docs, ~held_out(F.col("doc_id")))
    out = identified(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
