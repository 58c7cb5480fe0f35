"""Whitening against NumPy's eigenvectors of the exact covariance, and on odd rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import whitening
from tarn.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n string, x string"


def plain(vectors):
    """Fit list, eigenvalues and components by plain means."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    values, turns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, centred, values[::-1], turns[:, ::-1]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    made = (rng.standard_normal((400, 24)) * np.geomspace(3, 0.05, 24) @ rng.standard_normal((24, 24))).astype(np.float32)
    return [made[i] for i in range(400)] + [made[0]] * 150


def test_against_numpy(spark, vectors):
    rows = [(i, [float(c) for c in v], "clash", "clash") for i, v in enumerate(vectors)]
    rows += [(900, None, "", ""), (901, [1.0, None] + [0.0] * 22, "", ""), (902, [float("nan")] * 24, "", ""), (903, [float("inf")] * 24, "", ""), (904, [], "", ""), (None, rows[3][1], "", "")]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    x, n, sums, centred, values, turns = plain(vectors)
    assert len(found) == 16 * (len(vectors) + 1) and {r.component for r in found} == set(range(1, 17))
    by_id = {(r.vec_id, r.component): r for r in found}
    signs = {}
    for i, v in enumerate(x):
        for k in range(16):
            r = by_id[i, k + 1]
            assert r.n == n == 400 and r.deviation == sum((n * c - s) ** 2 for c, s in zip(v, sums))
            want = float(np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) @ turns[:, k]) / math.sqrt(values[k])
            sign = signs.setdefault(k, 1 if r.whitened * want > 0 else -1)
            assert r.whitened == pytest.approx(sign * want, abs=1e-9)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    assert by_id[None, 1].whitened == by_id[3, 1].whitened and by_id[0, 1].whitened == by_id[449, 1].whitened


def test_query_over_a_table(spark, vectors, tmp_path):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op13_whitening"](spark, str(tmp_path)).count() == 16 * len(vectors)


def test_lanczos_settles_early_and_counts_equal_values():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (np.geomspace(1e3, 1e-6, 200), np.r_[[5.0] * 9, [2.0] * 9, np.full(182, 1e-3)], np.r_[[7.0] * 3, np.zeros(197)], np.ones(200)):
        passes = []

        def multiply(block, values=values, passes=passes):
            passes.append(block.shape[1])
            return turn * values @ (turn.T @ block)

        found, vectors = whitening.block_lanczos(multiply, 200, 16)
        assert np.allclose(found, values[:16], rtol=1e-10, atol=1e-9)
        assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-10
        assert sum(passes) < 200  # far from the whole space


def test_lanczos_reaches_the_whole_space_and_begins_anew():
    values = np.array([4.0, 1.0, 1.0, 0.0, 0.0])
    found, vectors = whitening.block_lanczos(lambda v: values[:, None] * v, 5, 2)
    assert np.allclose(found, [4, 1])
    basis = np.eye(5)[:, :3]
    fresh = whitening.orthonormal(np.hstack([basis[:, :1], np.zeros((5, 1))]), basis, np.random.default_rng(1), 1.0)  # both break down
    whole = np.hstack([basis, fresh])
    assert np.abs(whole.T @ whole - np.eye(5)).max() < 1e-12


def test_few_flat_and_huge(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    found = whitening.whiten(make([(1, [1.0, 5.0, 0.0]), (2, [3.0, 5.0, 0.0]), (3, [1.0, 5.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 12), round(r.explained, 12)) for r in found) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (3, 1, 2, 1.0, 1.0)]
    assert {r.deviation for r in found} == {128**2}
    found = whitening.whiten(make([(1, [1e30, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.component for r in found} <= {1, 2} and all(math.isfinite(r.whitened) for r in found) and {r.deviation for r in found if r.vec_id == 1} == {None}
    with pytest.raises(ValueError, match="between 1 and 2"):
        whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(ValueError, match="names of the result"):
        whitening.whiten(make([]).withColumn("n", F.lit(1)), keep=("n",))


def test_sums_are_exact_beyond_64_bits():
    rng = random.Random(4)
    x = np.array([[rng.randint(-(2**52), 2**52) for _ in range(3)] for _ in range(500)], np.int64)
    sums = [sum(int(v) for v in c) for c in x.T]
    assert whitening.add_exactly(x).tolist() == sums
    exact = whitening.centred(500, sums)(x)
    assert exact.tolist() == [[500 * int(v) - s for v, s in zip(row, sums)] for row in x]
    assert whitening.squares(exact).tolist() == [sum(c * c for c in row) for row in exact.tolist()]
