"""Stateful exact deduplication against plain Python: in one go, in many batches, over files that come later, and with digests that collide."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tarn.llm import exact

SCHEMA = "doc_id long, text string, key string, n string, file string, row string"


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) by grouping texts in a dict; ``rows`` are in the order of their locators."""
    groups = {}
    for at, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for at, (doc_id, text) in enumerate(rows):
        content = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[content])
        out.append((doc_id, rows[best[3]][0], len(groups[content]), best[3] == at, hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out, key=str)


def write(spark, path, rows, mode="append"):
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA)
    df.coalesce(1).write.mode(mode).parquet(path)


def found(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cd", "é", "x y", "0"]) for _ in range(rng.randint(0, 5))) for _ in range(150)]
    texts += ["hot text"] * 120 + ["hottext", " hot\ttext\n", "x" * 100_000, "x" * 100_000 + " ", None, "", " \n", "　"]
    rng.shuffle(texts)
    made = [(rng.choice([i, i, i, None]), t) for i, t in enumerate(texts)]
    return made + [made[0], made[0], (7, "same id"), (7, "same id"), (7, "other text")]


def test_in_one_go_and_in_a_single_file(spark, rows, tmp_path):
    write(spark, f"{tmp_path}/documents.parquet", rows)
    assert found(exact.deduplicate(spark, f"{tmp_path}/documents.parquet/")) == plain(rows)
    part = next((tmp_path / "documents.parquet").glob("*.parquet"))
    part.rename(tmp_path / "one.parquet")
    assert found(exact.deduplicate(spark, f"file://{tmp_path}/one.parquet")) == plain(rows)


@pytest.mark.parametrize("bits", [0, 3])
def test_colliding_digests_change_nothing(spark, rows, tmp_path, bits):
    """Every hit of a digest of a few bits is told apart by its bytes."""
    write(spark, f"{tmp_path}/documents", rows)
    weak = lambda content: F.substring(F.unhex(F.hex(F.pmod(F.crc32(content), F.lit(2**bits)))), 1, 8)
    assert found(exact.deduplicate(spark, f"{tmp_path}/documents", key=weak)) == plain(rows)


def test_files_that_come_later_meet_the_state(spark, rows, tmp_path):
    path, folder = f"{tmp_path}/documents", f"file://{tmp_path}/state"
    for i, part in enumerate([rows[:100], rows[100:180], rows[180:]]):
        # file names give the order of locators
        write(spark, f"{tmp_path}/part", part, "overwrite")
        (tmp_path / "documents").mkdir(exist_ok=True)
        next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "documents" / f"part-{i}.parquet")
        stream = exact.Deduplicator(spark, path, folder, files_per_batch=1)  # a new object each time, as after a restart
        stream.ingest()
        assert found(stream.result()) == plain(rows[: [100, 180, len(rows)][i]])
    batches = stream.spark.read.parquet(f"{folder}/registry").select("batch").distinct().count()
    assert batches >= 3
    stream.ingest()  # nothing new
    assert found(stream.result()) == plain(rows)


def test_registry_state_is_on_disk_and_adds_up_before_the_shuffle(spark, rows, tmp_path):
    write(spark, f"{tmp_path}/documents", rows)
    stream = exact.Deduplicator(spark, f"{tmp_path}/documents", f"file://{tmp_path}/state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream.ingest()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert any(tmp_path.glob("state/checkpoint-registry/state/0/*/*.zip")) or any(tmp_path.glob("state/checkpoint-registry/state/0/*/*.changelog"))
    plan = exact.Deduplicator.summary(stream.table("arrivals", stream.rows), "key")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    known = {bytes(r.key): r for r in stream.known().collect()}
    assert sum(r.n for r in known.values()) == len(rows) and len(known) == len({x[4] for x in plain(rows)})


def test_only_wanted_texts_are_joined(spark, tmp_path):
    texts = [(i, f"text {i}") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(3)]
    write(spark, f"{tmp_path}/documents", texts)
    stream = exact.Deduplicator(spark, f"{tmp_path}/documents")
    stream.ingest()
    assert found(stream.result()) == plain(texts)
    wanted = stream.table("arrivals", stream.rows).where("id < 3").select("file", "row")
    assert sorted(r.content for r in stream.fetch(wanted).collect()) == ["text0", "text1", "text2"]


def test_empty_table(spark, tmp_path):
    write(spark, f"{tmp_path}/documents", [])
    assert found(exact.deduplicate(spark, f"{tmp_path}/documents")) == []
