"""Models are published whole: a save that dies, or files that were changed, never give half a model."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import encoders
from ticketlens.operators import semantics as S
from ticketlens.sources import published
from ticketlens.sources.tables import write_table


def level(spark, tab: str, name: str) -> S.LevelModel:
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "text string, embedding array<float>")
    return S.LevelModel(tab, encoders.TableEncoder(table), S.GivenCentroids(((1.0, 0.0), (0.0, 1.0))), ((0, name),), (0.9, -0.9))


def test_a_save_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    with pytest.raises(published.NotPublished):
        S.load_semantics(spark, path)
    assert S.save_semantics(S.SemanticModel({"A": level(spark, "A", "old")}), spark, path) == 1
    new = S.SemanticModel({"A": level(spark, "A", "new"), "B": level(spark, "B", "more")})
    done = []

    def dies(df, where, *args, **kwargs):
        done.append(where)
        if len(done) == 4:
            raise RuntimeError("killed")
        return write_table(df, where, *args, **kwargs)

    with monkeypatch.context() as patched:
        patched.setattr(S, "write_table", dies)
        with pytest.raises(RuntimeError):
            S.save_semantics(new, spark, path)
    assert len(done) == 4  # it had begun to write
    loaded = S.load_semantics(spark, path)
    assert list(loaded.levels) == ["A"] and loaded.levels["A"].labels == ((0, "old"),)
    assert S.save_semantics(new, spark, path) == 2
    assert {t: m.labels[0][1] for t, m in S.load_semantics(spark, path).levels.items()} == {"A": "new", "B": "more"}
    assert [r.version for r in published.versions(spark, path).orderBy("version").collect()] == [1, 2]


def test_a_model_without_levels_is_not_published(spark, tmp_path):
    with pytest.raises(ValueError):
        S.save_semantics(S.SemanticModel({}), spark, str(tmp_path / "m"))
    with pytest.raises(published.NotPublished):
        S.load_semantics(spark, str(tmp_path / "m"))


def test_a_manifest_that_is_being_written_is_not_read(spark, tmp_path):
    path = str(tmp_path / "m")
    published.publish(spark, path, lambda folder: spark.range(5).write.parquet(f"{folder}/t"))
    unfinished = tmp_path / "m" / "manifest" / "_temporary" / "0"
    unfinished.mkdir(parents=True)
    (unfinished / "part-0.json").write_text('{"version": 9, "name": "half", "files": []}')
    assert spark.read.parquet(f"{published.current(spark, path)}/t").count() == 5


def test_changed_and_missing_files_are_found(spark, tmp_path):
    path = str(tmp_path / "with space")

    def write(folder):
        for name in ("one", "two"):
            part = Path(folder) / "a b" / f"k={name}"
            part.mkdir(parents=True)
            (part / "part-0.bin").write_bytes(name.encode() * 9)

    published.publish(spark, path, write)
    folder = Path(published.current(spark, path))
    changed = folder / "a b" / "k=one" / "part-0.bin"
    whole = changed.read_bytes()
    for other in (whole[:-1], whole[::-1], b""):
        changed.write_bytes(other)
        with pytest.raises(published.Damaged, match="1 files of version 1"):
            published.current(spark, path)
    assert published.current(spark, path, check=False) == str(folder)
    changed.write_bytes(whole)
    assert published.current(spark, path) == str(folder)


def test_the_later_name_wins_between_equal_numbers(spark, tmp_path):
    path = str(tmp_path / "m")
    for _ in range(2):
        published.publish(spark, path, lambda folder: spark.range(1).write.parquet(folder))
    entries = published._entries(spark, path).withColumn("version", F.lit(1).cast("long"))
    other = str(tmp_path / "n")
    entries.write.json(f"{other}/manifest")
    names = [r.name for r in entries.collect()]
    assert published.current(spark, other, check=False).endswith(max(names))
    with pytest.raises(published.Damaged):  # a manifest without its files
        published.current(spark, other)
