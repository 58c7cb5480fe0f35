import hashlib
import random

import numpy as np
import pytest

from tarn.llm import suffixes
from tarn.llm.gsaca import suffix_arrays
from tarn.llm.suffixes import WINDOW, remove_repeats


def brute(rows):
    """(id, text or None) -> {id: (n_bytes, n_removed, n_spans, kept)} by looking at every window."""
    seen, out = {}, {}
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    for i, raw in docs:
        for at in range(len(raw) - WINDOW + 1):
            key = raw[at : at + WINDOW]
            seen[key] = min(seen.get(key, (i, at)), (i, at))
    for i, raw in docs:
        cut = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - WINDOW + 1):
            if seen[raw[at : at + WINDOW]] < (i, at):
                cut[at : at + WINDOW] = True
        kept = bytes(c for c, x in zip(raw, cut) if not x)
        spans = int(((cut[1:] & ~cut[:-1]).sum()) + cut[0])
        out[i] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, with_text=False).collect()}
    assert got == brute(rows)


def test_suffix_arrays_against_sorting():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.randrange(1, rng.choice([2, 3, 5, 30]) + 1) for _ in range(rng.randrange(0, rng.choice([3, 20, 120])))] + [0] for _ in range(rng.randrange(1, 8))]
        flat, offsets = [], [0]
        for t in texts:
            flat += [0, *t]
            offsets.append(len(flat))
        found = suffix_arrays(np.array(flat, np.int64), np.array(offsets))
        for k, t in enumerate(texts):
            at = offsets[k] + 1
            assert (found[at : offsets[k + 1]] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_edges(spark):
    long_run = "a" * 700
    check(spark, [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "y" + "x" * 100), (6, long_run), (7, long_run + "b" + long_run)])


def test_random_copies_and_edits(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(10, 120))) for _ in range(12)]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("xyz") + t[k + 1 :]
        elif kind < 0.6:
            other = rng.choice(base)
            a, b = sorted(rng.sample(range(len(other)), 2))
            t = t[: rng.randrange(len(t))] + other[a:b] + t[rng.randrange(len(t)) :]
        elif kind < 0.7:
            t = t + "|" + t
        rows.append((i * 3 % 61, t))
    check(spark, rows)


def test_many_contexts_of_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "TEXT_BYTES", 600)
    rng = random.Random(5)
    phrase = "the quick brown fox jumps over the lazy dog and then it sleeps"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 200))) + phrase + "".join(rng.choice("ab") for _ in range(60))) for i in range(40)]
    rows += [(100 + i, rows[i][1][20:]) for i in range(20)]
    check(spark, rows)


@pytest.mark.parametrize("most", [300, 3000])
def test_pieces_of_a_hot_anchor(spark, monkeypatch, most):
    """A phrase in few and many surroundings that agree on one side, on both, or nearly; rows stream by in small groups."""
    monkeypatch.setattr(suffixes, "TEXT_BYTES", most)
    monkeypatch.setattr(suffixes, "STEP_BYTES", 4 * most)
    monkeypatch.setattr(suffixes, "STREAM_ROWS", 7)
    monkeypatch.setattr(suffixes, "STREAM_BYTES", 4 * most)
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("ab") for _ in range(k))
    phrase = "".join(rng.choice("klmnopqrst") for _ in range(55))
    lefts, rights = [word(70) for _ in range(4)], [word(70) for _ in range(4)]
    rows = [(i, rng.choice(lefts)[rng.randint(0, 20) :] + phrase + rng.choice(rights)[: rng.randint(30, 70)]) for i in range(60)]
    rows += [(100 + i, word(50) + rng.choice(lefts)[-rng.randint(1, 60) :] + phrase + rng.choice(rights)[: rng.randint(1, 60)] + word(50)) for i in range(60)]
    rows += [(200 + i, word(30) + phrase + phrase + word(30)) for i in range(20)]
    check(spark, rows)


def test_repeated_ids_do_not_precede_each_other(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abc ") for _ in range(400))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 400)]


def test_null_ids_and_other_texts_of_an_id_are_documents(spark):
    rng = random.Random(7)
    a, b, c, d = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (400, 300, 120, 500))
    rows = [(1, a), (None, b), (None, b), (None, d + a), (None, c), (2, d), (2, c + a), (2, d)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # texts of id 2 are d and c + a in either order; they share nothing
    found = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    assert found == sorted([(1, 400, 0), (0, 300, 0), (0, 300, 300), (0, 900, 900), (0, 120, 120), (2, 500, 0), (2, 520, 400), (2, 500, 0)])


def test_text_longer_than_packed_positions(spark):
    rng = random.Random(7)
    block = bytes(rng.choice(b"abcdefgh") for _ in range(300)).decode()
    text = "".join(rng.choice("ijklmnop") for _ in range(1_200_000)) + block + "z" + block
    df = spark.createDataFrame([(1, text), (2, text[1_048_000:1_049_000])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in remove_repeats(df, with_text=False).collect()}
    assert got == {1: 300, 2: 1000}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert remove_repeats(df).collect() == []


@pytest.mark.parametrize("count", [1, 3])
def test_ranges_merge(count):
    doc, a, b = suffixes.merged(np.array([1, 1, 0, 1] * count), np.array([5, 0, 3, 9] * count), np.array([9, 2, 4, 12] * count))
    assert list(zip(doc, a, b)) == [(0, 3, 4), (1, 0, 2), (1, 5, 12)]
