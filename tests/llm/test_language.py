from pyspark.sql import functions as F

from ticketlens.llm import language
from ticketlens.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op3_zstd_language"](spark, sf).join(docs, "doc_id").filter("held_out")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.9


def test_odd_rows(spark, odd_docs):
    dictionaries = language.training_slices(odd_docs, F.lit(True))
    assert set(dictionaries) == {"en", "fr"}
    out = language.identified(odd_docs, dictionaries)
    assert out.columns.count("score") == 1 and "key" in out.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd_docs.count()
    for i in (4, 5, 6, 12):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[0].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in rows.values())
    assert (rows[0].lang_pred, rows[0].score) == (rows[1].lang_pred, rows[1].score)


def test_without_training_rows(no_docs, odd_docs):
    assert language.training_slices(no_docs, F.lit(True)) == {}
    assert {r.lang_pred for r in language.identified(odd_docs, {}).collect()} == {"und"}
    assert language.identified(no_docs, {}).count() == 0


def test_narrow_margin_is_rejected():
    same = language.Guesser({"a": b"abc def ghi " * 50, "b": b"abc def ghi " * 50})
    assert same.guess("abc def")[2] and same.guess("abc def")[0] == "a"
    apart = language.Guesser({"a": b"the cat sat on the mat with a hat " * 30, "b": b"ein zwei drei vier auf dem dach da " * 30})
    assert apart.guess("the cat sat on the mat with a hat")[:1] == ("a",) and not apart.guess("ein zwei drei vier auf dem dach da")[2]


def test_signs_that_are_no_letters():
    guesser = language.Guesser({"a": b"abc def ghi " * 50})
    for text in ("\u00bd \u00b2", "\u2167 12", "_ -- 7", ""):
        assert guesser.guess(text) == ("und", 0.0, True)
    assert guesser.guess("\u00bd \u00e9")[0] == "a"
