"""The versioned cache: deletions, older versions, writers that die or race, compaction and clearing."""

import os

import pytest
from pyspark.sql import functions as F

from tarn.sources import sinks
from tarn.sources.cache import CacheError, NoteCache


def notes(spark, **bodies):
    rows = spark.createDataFrame([(p, b) for p, b in bodies.items()], "path string, body string")
    return rows.withColumn("fields", F.parse_json(F.concat(F.lit('{"n": '), F.length("body").cast("string"), F.lit("}"))))


def shown(df):
    return {r.path: r.body for r in df.collect()}


@pytest.fixture
def cache(spark, tmp_path):
    return NoteCache(spark, f"file://{tmp_path}/cache")


def test_versions(spark, cache):
    assert cache.read() is None and cache.versions() == []
    with pytest.raises(CacheError, match="first version"):
        cache.write(gone=notes(spark, a="x"))
    assert cache.write(notes(spark, a="1", b="2", c="3")) == 1
    reader = cache.read()
    assert cache.write(notes(spark, a="new", d="4"), gone=notes(spark, b="")) == 2
    assert shown(reader) == {"a": "1", "b": "2", "c": "3"}  # a reader keeps its version
    assert shown(cache.read()) == {"a": "new", "c": "3", "d": "4"} and shown(cache.read(1)) == {"a": "1", "b": "2", "c": "3"}
    assert cache.write(notes(spark, b="again", c="both"), gone=notes(spark, c="")) == 3
    assert shown(cache.read()) == {"a": "new", "b": "again", "d": "4"}
    assert [r.fields for r in cache.read().where("path = 'a'").collect()] == ['{"n":3}']
    assert cache.compact() == 4 and shown(cache.read()) == shown(cache.read(3)) and len(cache.manifest()["tables"]) == 1
    assert cache.write(gone=notes(spark, a="", nothing="")) == 5
    assert shown(cache.read()) == {"b": "again", "d": "4"}
    assert len(cache.vacuum(keep=1)) == 3 and cache.versions() == [5] and shown(cache.read()) == {"b": "again", "d": "4"}
    with pytest.raises(CacheError, match="no version 1"):
        cache.read(1)


def test_a_writer_that_dies_changes_nothing(spark, cache, tmp_path, monkeypatch):
    cache.write(notes(spark, a="1"))

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(NoteCache, "publish", die)  # between data and manifest
    with pytest.raises(KeyboardInterrupt):
        cache.write(notes(spark, a="lost"))
    monkeypatch.undo()
    assert cache.versions() == [1] and shown(cache.read()) == {"a": "1"}
    assert len(os.listdir(tmp_path / "cache" / "tables")) == 2
    assert cache.write(notes(spark, b="2")) == 2 and shown(cache.read()) == {"a": "1", "b": "2"}
    assert len(cache.vacuum(keep=2)) == 1 and shown(cache.read(1)) == {"a": "1"}


def test_of_two_writers_one_is_refused(spark, cache):
    cache.write(notes(spark, a="1"))
    schema, tables = cache.manifest()["columns"], cache.manifest()["tables"]
    cache.write(notes(spark, a="first"))
    with pytest.raises(CacheError, match="another writer"):
        cache.publish(2, schema, tables)
    assert shown(cache.read()) == {"a": "first"} and cache.versions() == [1, 2]


def test_another_layout_is_built_anew(spark, cache, monkeypatch):
    monkeypatch.setattr("tarn.sources.cache.CACHE_VERSION", 0)
    cache.write(notes(spark, a="old"))
    monkeypatch.undo()
    assert cache.read() is None
    assert cache.write(notes(spark, b="new")) == 2 and shown(cache.read()) == {"b": "new"}


def test_files_are_deleted_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("sub", "y")], "name string, content string")
    sinks.write_rows_as_files(rows, str(tmp_path))
    sinks.delete_rows_as_files(rows.where("name = 'a'"), str(tmp_path))
    sinks.delete_rows_as_files(rows.where("name = 'a'"), str(tmp_path))
    assert sorted(p.name for p in tmp_path.glob("*.md")) == ["sub.md"]
    with pytest.raises(Exception, match="leaves its directory"):
        sinks.delete_rows_as_files(rows.withColumn("name", F.lit("../a")), str(tmp_path))
