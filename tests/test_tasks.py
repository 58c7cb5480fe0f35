"""Task trees by intervals against a plain walk over parents, at any shape and size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarn.operators import tasks


def body(rng, lines):
    out = []
    for i in range(lines):
        out.append(rng.choice(["# Head", "text", "", "  " * rng.randint(0, 6) + f"- [{rng.choice('x X-')}] t{i}", "  " * rng.randint(0, 6) + f"{rng.choice('-*+')} i{i}", "\t" * rng.randint(0, 3) + f"{i}. [ ] n{i}"]))
    return rng.choice(["\n", "\r\n"]).join(out)


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(6)
    rows = [(f"n{i}.md", body(rng, rng.randint(0, 60))) for i in range(40)] + [("none.md", None), ("empty.md", ""), (None, "- [ ] a\n  - [x] b"), ("deep.md", "\n".join("  " * i + "- [x] d" for i in range(300)))]
    return tasks.items(spark.createDataFrame(rows, "path string, body string").repartition(3)).cache()


def trees(rows):
    """Ancestors of each (path, line), itself first."""
    parent = {(r.path, r.line): r.parent_line for r in rows}
    out = {}
    for path, line in parent:
        chain = [line]
        while parent[path, chain[-1]] is not None:
            chain.append(parent[path, chain[-1]])
        out[path, line] = chain
    return out


def test_parents_and_intervals(found):
    rows = found.collect()
    above = trees(rows)
    notes = {}
    for r in sorted(rows, key=lambda r: (str(r.path), r.line)):
        notes.setdefault(r.path, []).append(r)
    for own in notes.values():
        assert [r.nth for r in own] == list(range(len(own)))
        for i, r in enumerate(own):
            before = [x.line for x in own[:i] if x.indent < r.indent]
            assert r.parent_line == (before[-1] if before else None)
            assert [x.nth for x in own if r.line in above[x.path, x.line]] == list(range(r.nth, r.last + 1))


def test_expand_children_and_completion(found):
    rows = found.collect()
    above = trees(rows)
    done = {(r.path, r.line): (not r.task or r.completed) for r in rows}
    pairs = sorted(((p, a, line) for (p, line), chain in above.items() for a in chain), key=str)
    for given in (found, found.drop("nth", "last")):  # intervals at hand, or from the parents
        assert sorted(((r.path, r.root_line, r.line) for r in tasks.expand(given, given).collect()), key=str) == pairs
        full = {(r.path, r.line): r.fully_completed for r in tasks.fully_completed(given).collect()}
        assert full == {k: all(done[p, line] for p, a, line in pairs if (p, a) == k) for k in above}
        chosen = {(r.path, r.line) for r in rows if r.completed}
        want = sorted((k for k, chain in above.items() if any((k[0], a) in chosen for a in chain)), key=str)
        for kept in (tasks.matching_with_children(given, F.col("completed")), tasks.with_children(given, given.where("completed"))):
            assert kept.columns == given.columns and sorted(((r.path, r.line) for r in kept.collect()), key=str) == want


def test_expanded_items_are_not_gathered_on_the_driver(spark):
    """Spark guesses that the items of a small table of notes are few; a broadcast of them would be over the limit set here."""
    notes = spark.range(3000).select(F.col("id").alias("path"), F.lit("- [x] a\n  - [ ] b\n    - [x] c").alias("body"))
    found = tasks.items(notes)
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "10k")
        rows = tasks.expand(found, found.where("completed")).groupBy("root_line", "line").count().collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted((r.root_line, r.line, r["count"]) for r in rows) == [(0, 0, 3000), (0, 1, 3000), (0, 2, 3000), (2, 2, 3000)]


def test_items_above_themselves_are_an_error(spark):
    loop = spark.createDataFrame([("a", 1, 2, True, True), ("a", 2, 1, True, True)], "path string, line int, parent_line int, task boolean, completed boolean")
    with pytest.raises(Exception, match="above themselves"):
        tasks.fully_completed(loop).collect()


def test_cost_is_linear_in_lines():
    def seconds(n):
        text = "\n".join("  " * (i % 50) + "- [ ] t" for i in range(n))
        best = 9e9
        for _ in range(3):
            t = time.perf_counter()
            assert len(tasks.items_of(text)["line"]) == n
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(160_000) < 30 * seconds(16_000)  # a list for each line would take a hundred times as long


def test_items_of_many_notes_share_batches_and_all_cores(spark):
    import pyarrow as pa

    texts = ["- [x] a\n  - b", None, ""] * 1000 + ["- c"]
    given = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["path", "body"])
    out = list(tasks.item_batches([given.slice(0, 0), given, given.slice(0, 3), given.slice(1, 2)]))
    assert [b.num_rows for b in out] == [2001, 2]
    assert out[0].column(0).to_pylist() == [i for i, t in enumerate(texts) for _ in range((t or "").count("- "))]
    deep = pa.record_batch([pa.array([1, 2, 3]), pa.array(["- a\n" * tasks.BATCH_ITEMS, "- b", None])], names=["path", "body"])
    assert [b.num_rows for b in tasks.item_batches([deep])] == [tasks.BATCH_ITEMS, 1]
    notes = spark.createDataFrame([(i, "- a") for i in range(100)], "path long, body string").coalesce(1)
    found = tasks.items(notes)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 100
