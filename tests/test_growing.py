"""Enrichment with a stored dictionary of scored texts."""

from pyspark.sql import functions as F

from ticketlens import fixtures as X
from ticketlens import schemas
from ticketlens.operators import semantics as S

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_only_new_texts_are_scored(spark, tmp_path):
    path = str(tmp_path / "texts")
    df = X.tickets(spark, SF_DIR).limit(200)
    extra = df.limit(20).withColumn("TAB_N1", F.lit("a text of its own")).withColumn("TAB_N2", F.lit(None).cast("string"))
    model = S.fit_semantics(df.unionByName(extra), S.text_levels(["TAB_N1", "TAB_N2"]))
    columns = ["PROTOCOLO", *(f"{t}_{c}" for t in model.levels for c in ("GROUP", "SENT_SCORE", "SENT_LABEL"))]
    first = S.enrich_growing(model, df, path, ["PROTOCOLO"])
    assert rows_of(first.tickets, columns) == rows_of(model.transform(df), columns)
    assert first.new_texts.count() == S.text_dictionary(df, list(model.levels)).count()
    both = df.unionByName(extra)
    second = S.enrich_growing(model, both, path, ["PROTOCOLO"])
    known = {(r.tab, r.text) for r in first.new_texts.collect()}
    wanted = {(r.tab, r.text) for r in S.text_dictionary(both, list(model.levels)).collect()} - known
    assert {(r.tab, r.text) for r in second.new_texts.collect()} == wanted and ("TAB_N1", "a text of its own") in wanted
    assert rows_of(second.tickets, columns) == rows_of(model.transform(both), columns)
    # a batch that was appended twice counts once
    spark.read.schema(S._SCORED_TEXT).parquet(path).write.mode("append").partitionBy("model", "tab").parquet(path + "-twice")
    spark.read.schema(S._SCORED_TEXT).parquet(path).write.mode("append").partitionBy("model", "tab").parquet(path + "-twice")
    third = S.enrich_growing(model, both, path + "-twice", ["PROTOCOLO"])
    assert third.new_texts.count() == 0 and rows_of(third.tickets, columns) == rows_of(second.tickets, columns)
    # another fit knows none of them
    other = S.fit_semantics(df, S.text_levels(["TAB_N2"]))
    assert other.key() != model.key()
    assert S.enrich_growing(other, df, path).new_texts.count() == S.text_dictionary(df, ["TAB_N2"]).count()


def test_empty_tables_and_missing_columns(spark, tmp_path):
    df = X.tickets(spark, SF_DIR).limit(50)
    model = S.fit_semantics(df, S.text_levels(["TAB_N1"]))
    none = S.enrich_growing(model, spark.createDataFrame([], schemas.RAW_TICKETS), str(tmp_path / "none"))
    assert none.tickets.count() == 0 and none.new_texts.count() == 0 and "TAB_N1_GROUP" in none.tickets.columns
    without = S.enrich_growing(model, df.drop("TAB_N1"), str(tmp_path / "without"))
    assert without.tickets.count() == 50 and without.new_texts.count() == 0
