"""The notes format: order, partitions, pushed filters, errors, and a stream that takes in what changes."""

import os

import pytest
from pyspark.sql import functions as F

from tarn.sources.note_source import File, Reader, dealt, listed, read_notes, register


@pytest.fixture
def vault(tmp_path):
    for name, text, moment in (
        ("b.md", "---\nfileClass: book\nn: 1\n---\nbody", 1000), ("a/z.md", "plain", 2000), ("a/x.md", "---\nfileClass: note\n---", 3000), ("a.b/c.md", "---\nbad: [\n---\nx", 4000), ("other.txt", "no", 5000),
    ):
        path = tmp_path / "vault" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (moment, moment))
    (tmp_path / "vault" / "latin.md").write_bytes(b"\xff\xfe")
    os.utime(tmp_path / "vault" / "latin.md", (6000, 6000))
    return str(tmp_path / "vault")


def test_rows(spark, vault):
    rows = {os.path.relpath(r.path, vault): r for r in read_notes(spark, vault).select("*", F.to_json("fields").alias("json")).collect()}
    assert set(rows) == {"b.md", "a/z.md", "a/x.md", "a.b/c.md", "latin.md"}
    assert (rows["b.md"].file_class, rows["b.md"].json, rows["b.md"].body) == ("book", '{"fileClass":"book","n":1}', "body")
    assert (rows["a/z.md"].json, rows["a/z.md"].body, rows["a/x.md"].body) == ("{}", "plain", "")
    assert "a.b/c.md" in rows["a.b/c.md"].error and rows["a.b/c.md"].body is None and "utf-8" in rows["latin.md"].error
    assert [r.n for r in read_notes(spark, f"file://{vault}", pattern="b*").select(F.expr("fields:n::int").alias("n")).collect()] == [1]


def test_walk_order_and_first_error(spark, vault):
    assert [os.path.relpath(f.path, vault) for f in listed(vault, "*.md")] == ["a/x.md", "a/z.md", "a.b/c.md", "b.md", "latin.md"]
    with pytest.raises(Exception, match="a.b/c.md"):  # before latin.md in the walk
        read_notes(spark, vault, errors="stop").collect()
    with pytest.raises(Exception, match="kept or stop"):
        read_notes(spark, vault, errors="maybe").collect()


def test_options_open_fewer_files(spark, vault):
    reader = Reader({"path": vault, "under": "a/", "changedafter": "1970-01-01T00:34:00"})
    assert [os.path.basename(f.path) for p in reader.partitions() for f in p.files] == ["x.md"]
    # files that would end the job are excluded by the listing, so they are not opened
    names = lambda **options: sorted(os.path.basename(r.path) for r in read_notes(spark, vault, errors="stop", **options).collect())
    assert names(under="a/") == ["x.md", "z.md"] and names(changedBefore="1970-01-01T01:00:00+00:00") == ["b.md", "x.md", "z.md"] and names(pattern="[a-k]*.md", changedAfter="1970-01-01T02:00:00") == []
    assert [os.path.basename(r.path) for r in read_notes(spark, vault, file_class="book").collect()] == ["b.md"]
    rows = read_notes(spark, vault)  # one DataFrame in several queries
    assert (rows.where("file_class = 'note'").count(), rows.count(), rows.where("size > 3").union(rows).count()) == (1, 5, 9)


def test_partitions_by_size():
    files = [File(f"{i}", 0, size) for i, size in enumerate([10_000, 1, 1, 50_000, 90_000, 4000])]
    assert [[f.path for f in p.files] for p in dealt(files, 60_000)] == [["0", "1", "2"], ["3"], ["4"], ["5"]]


def test_stream_takes_in_what_is_new_or_changed(spark, vault, tmp_path):
    register(spark)

    def run():
        stream = spark.readStream.format("notes").load(vault).select("path", "body")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(os.path.basename(r.path) + ":" + str(r.body) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = run()
    assert len(first) == 5
    assert run() == first  # nothing new
    (tmp_path / "vault" / "new.md").write_text("n")
    (tmp_path / "vault" / "b.md").write_text("changed")
    assert run() == sorted([*first, "new.md:n", "b.md:changed"])


def test_empty_folder(spark, tmp_path):
    assert read_notes(spark, str(tmp_path)).collect() == []
