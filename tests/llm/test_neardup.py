"""Near-duplicates of a stated similarity against all pairs: recall by length, no clean text lost, groups, templates and edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import neardup

KEY = ("k",)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    return ["".join(rng.choice("aeioubcdlmnr") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def similar(a, b):
    x, y = set(neardup.shingles(a).tolist()), set(neardup.shingles(b).tolist())
    return len(x & y) / max(1, len(x | y))


def changed(rng, words, text, most):
    """A copy with words changed, one after the other, as long as it stays similar enough."""
    own = text.split()
    last = text
    for _ in range(most):
        own[rng.randrange(len(own))] = rng.choice(words)
        if similar(text, " ".join(own)) < neardup.SIMILARITY:
            break
        last = " ".join(own)
    return last


@pytest.mark.parametrize("length", [8, 15, 25, 50, 100, 300, 1000, 3000])
def test_blocks_are_shared(words, length):
    """Recall of the candidates at the least similarity that is promised, by length."""
    rng = random.Random(length)
    found = tried = 0
    for _ in range(150 if length < 1000 else 40):
        a = " ".join(rng.choice(words) for _ in range(length))
        b = changed(rng, words, a, length)
        if a != b:
            tried += 1
            found += bool(set(neardup.sketch(a)[3]) & set(neardup.sketch(b)[3])) and bin((neardup.sketch(a)[2] ^ neardup.sketch(b)[2]) % 2**64).count("1") <= neardup.CLOSE_BITS
    assert not tried or found / tried >= 0.95


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k long").withColumn("node", F.lit("clash")).withColumn("fp", F.lit("clash")).repartition(5)


def test_one_of_each_group_stays(spark, words):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(20, 400)) for _ in range(200)]
    pairs = [(i, changed(rng, words, texts[i], rng.choice([1, 3, 100]))) for i in range(120)]
    texts += [t for _, t in pairs] + texts[:10]
    hot = prose(200)
    texts += [changed(rng, words, hot, 2) for _ in range(150)]  # a large group of near copies
    shape = prose(60)
    texts += [shape + " " + prose(40) for _ in range(40)]  # one template, too little in common
    kept = {r.k for r in neardup.firsts(rows_of(spark, texts).select("doc_id", "text", "k"), KEY).collect()}
    assert {i for i in range(200)} <= kept  # the first of each group, and every text without a near copy
    gone = [i for i in range(200, 320) if i not in kept]
    assert len(gone) >= 0.95 * 120 and not kept & set(range(320, 330))
    assert 330 in kept and len(kept & set(range(330, 480))) <= 3
    assert set(range(480, 520)) <= kept


def test_pairs_inside_a_template_are_found(spark, words):
    """Texts that share blocks with many others, of which only one is close."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shape = prose(150)
    texts = [shape + " " + prose(60) for _ in range(60)]
    texts += [changed(rng, words, t, 1) for t in texts]
    kept = {r.k for r in neardup.firsts(rows_of(spark, texts).select("doc_id", "text", "k"), KEY).collect()}
    assert set(range(60)) <= kept and len(kept) <= 66


@pytest.mark.parametrize("chunk", [20, 2000])
def test_no_pair_of_a_block_is_missed(spark, words, monkeypatch, tmp_path, chunk):
    """Similar texts in one block with many others, far from each other in the order of fingerprints."""
    monkeypatch.setattr(neardup, "CHUNK", chunk, raising=False)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(50)]
    texts += [changed(rng, words, t, 1) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string").cache()
    nodes = spark.createDataFrame([(i, i % 50 * 64 + (i // 50) * (2**62 + 1), [7], i) for i in range(100)], "node long, fp long, blocks array<bigint>, k long")
    found = {(r.u, r.v) for r in neardup.near_edges(rows, nodes, KEY, f"file://{tmp_path}/near").collect()}
    assert found == {(i + 50, i) for i in range(50) if texts[i] != texts[i + 50]}


def test_a_large_cluster_merges_before_its_pairs_are_formed(spark, words, monkeypatch):
    """Copies of a text that isn't there, each close to some of the others: their groups meet before all pairs do, and the same texts stay."""
    rng = random.Random(6)
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(250):
        own = list(base)
        own[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(own))
    rows = rows_of(spark, [*texts, " ".join(rng.choice(words) for _ in range(80))]).select("doc_id", "text", "k").cache()
    formed, apart = [], neardup.apart

    def counted(grouped, sets):
        found = apart(grouped, sets)
        formed.append(found.count())
        return found

    monkeypatch.setattr(neardup, "apart", counted)
    kept = [r.k for r in neardup.firsts(rows, KEY).collect()]
    monkeypatch.setattr(neardup, "MERGES", 0)
    assert sorted(kept) == sorted(r.k for r in neardup.firsts(rows, KEY).collect()) == [0, 250]
    assert formed[0] <= 250 < 1000 <= formed[1]


def test_shuffle_files_go_with_their_queries(spark, words):
    """No garbage collection is needed for it: the rounds' small queries would leave thousands of files."""
    import gc
    import glob
    import time

    rng = random.Random(9)
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(80):
        own = list(base)
        own[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(own))
    rows = rows_of(spark, texts).select("doc_id", "text", "k")
    where = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in where for f in glob.glob(f"{d}/*/shuffle_*")}
    gc.collect()
    before = files()
    first = neardup.firsts(rows, KEY)  # its own query is not run yet
    for _ in range(50):
        if len(files() - before) <= 60:
            break
        time.sleep(0.1)
    assert len(files() - before) <= 60
    assert [r.k for r in first.collect()] == [0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64)])
        differing = int(np.bitwise_count((neardup.parity(a) ^ neardup.parity(b)).view(np.uint64)).sum())
        assert len(neardup.parity(a)) == 4 and differing <= len(np.setxor1d(a, b)) and (differing - len(np.setxor1d(a, b))) % 2 == 0


def test_edges(spark):
    texts = [None, "", " \n", "one", "one", "ONE", "a b c d", "a b c d e", "a b c d e f", "é " * 3000, "x" * 200_000, "x" * 200_000]
    df = spark.createDataFrame([(None if i == 3 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k long")
    assert sorted(r.k for r in neardup.firsts(df, KEY).collect()) == [0, 4, 6, 7, 8, 9, 10]
    assert neardup.firsts(df.limit(0), KEY).collect() == []
    assert neardup.blocks(np.zeros(0, np.uint64)) == [] and len(neardup.blocks(np.array([5], np.uint64))) == 1
