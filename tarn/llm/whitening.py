"""Whitening of embeddings: principal components by a block Lanczos iteration that only ever multiplies with the data.

Every entry c becomes the integer x = floor(64 c) + 1000000, and the *fit list* is each different vector x once. The covariance is never formed: a
*pass* sends a few vectors V to the tasks, and each adds up (X - mean)' ((X - mean) V) over its rows of the fit list. The driver holds the basis (one
row for each dimension), its products and nothing that grows with the number of rows. :func:`block_lanczos` orthogonalises each new block against the
whole basis twice, fills it with random directions where it breaks down, and stops once the residuals of the wanted pairs are settled. A
block has as many vectors as components are wanted, so equal eigenvalues are all found.

The trace, for the explained shares, is the sum of the rows' deviations from the mean and doesn't need the other components.

Defined results: vectors that are null, empty, or hold a null or a non-finite entry take no part and give no rows; rows that repeat are all returned but
fitted once; null ids are kept. Entries beyond 2^46 count as that bound. A deviation that no long can hold is null. Directions without spread
(an eigenvalue below ``FLAT`` of the largest) have no whitened value and are left out, so fewer components than asked for may come back, and a table
without two different vectors gives no rows. Vectors of different lengths raise an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import arrow_schema, record_batch, shared_folder

SCALE, OFFSET = 64, 1_000_000
#: Residual, as a part of the largest eigenvalue, at which a pair is settled.
SETTLED = 1e-13
#: Part of the largest eigenvalue below which a direction counts as without spread.
FLAT = 1e-12
MOST = float(2**52)


def usable(vector: Column) -> Column:
    """True for vectors with entries that are all finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def integers(vector: Column) -> Column:
    bounded = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))
    return F.transform(vector, lambda c: F.floor(bounded(c)).cast("long") + F.lit(OFFSET).cast("long"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def block_lanczos(multiply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, settled: float = SETTLED, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, of a symmetric positive operator and their unit vectors as columns. ``multiply`` is called once a round."""
    wanted = min(wanted, size)
    rng = np.random.default_rng(seed)
    basis, products = np.zeros((size, 0)), np.zeros((size, 0))
    block = orthonormal(rng.standard_normal((size, wanted)), basis, rng, 1.0)
    while True:
        product = multiply(block)
        basis, products = np.hstack([basis, block]), np.hstack([products, product])
        projected = basis.T @ products
        values, turns = np.linalg.eigh((projected + projected.T) / 2)
        values, turns = values[::-1][:wanted], turns[:, ::-1][:, :wanted]
        vectors = basis @ turns
        residual = np.linalg.norm(products @ turns - vectors * values, axis=0)
        if basis.shape[1] == size or (residual <= settled * max(values[0], 0)).all():
            return values, vectors
        block = orthonormal(product[:, : size - basis.shape[1]], basis, rng, abs(values).max())


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, norm: float) -> np.ndarray:
    """Columns of ``block`` made orthogonal to ``basis`` and each other; those that vanish against ``norm`` are begun anew at random."""
    out = basis
    for column in block.T:
        least = 1e-12 * norm
        while True:
            before = column
            for _ in range(3):
                column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left > least and left > 1e-12 * np.linalg.norm(before):
                column = column / left
                column = column - out @ (out.T @ column)
                out = np.column_stack([out, column / np.linalg.norm(column)])
                break
            column, least = rng.standard_normal(len(column)), 0.0
    return out[:, basis.shape[1] :]


class Fit:
    """The fit list, its number of vectors and their exact sums, with distributed passes over it."""

    def __init__(self, vectors: DataFrame, path: str):
        vectors.distinct().write.parquet(path)
        self.rows = vectors.sparkSession.read.schema("x array<bigint>").parquet(path)
        shortest, longest, self.n = self.rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
        if shortest != longest:
            raise ValueError(f"vectors have between {shortest} and {longest} entries")
        self.size = longest or 0
        self.sums = [int(s) for s in self.added(add_exactly, "decimal(38,0)", self.size)]
        self.centre = centred(self.n, self.sums)

    def added(self, work: Callable[[np.ndarray], np.ndarray], kind: str, size: int) -> list:
        """Sum over all rows of the vectors that ``work`` makes of blocks of rows: one vector leaves a task, and Spark adds them by place."""
        if not self.n:
            return [0] * size
        kinds = arrow_schema(self.rows.sparkSession, f"part array<{kind}>")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = work(matrix(batch.column(0)))
                    total = part if total is None else total + part
            if total is not None:
                yield record_batch({"part": [total.tolist()]}, kinds)

        parts = self.rows.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "value"))
        found = dict(parts.groupBy("at").agg(F.sum("value")).collect())
        return [found[i] for i in range(size)]

    def multiply(self, block: np.ndarray) -> np.ndarray:
        """Covariance times ``block``, in one pass that never forms the covariance."""
        n, centre = self.n, self.centre

        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x).astype(np.float64) / n
            return (c.T @ (c @ block)).ravel()

        return np.array(self.added(work, "double", block.size)).reshape(block.shape) / n

    def trace(self) -> float:
        """Trace of the covariance, from the exact deviations of the rows."""
        centre = self.centre
        return float(Fraction(int(self.added(lambda x: exact_total(squares(centre(x))), "decimal(38,0)", 1)[0]), max(self.n, 1) ** 3))

    def identity_error(self, turn: np.ndarray) -> float:
        """Largest entry of the whitened fit list's covariance minus the identity, by one more pass."""
        n, centre, count = self.n, self.centre, turn.shape[1]

        def work(x: np.ndarray) -> np.ndarray:
            w = centre(x).astype(np.float64) / n @ turn
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        sums = np.array(self.added(work, "double", count + count * count))
        mean = sums[:count] / n
        return float(np.abs(sums[count:].reshape(count, count) / n - np.outer(mean, mean) - np.eye(count)).max())


def add_exactly(x: np.ndarray) -> np.ndarray:
    """Sums by column as Python's integers: the high and the low half of each number are added apart, so that no sum overflows."""
    high, low = (x >> 30).sum(0), (x & (2**30 - 1)).sum(0)
    return high.astype(object) * 2**30 + low.astype(object)


def exact_total(values: np.ndarray) -> np.ndarray:
    return np.array([sum(values.tolist())], object)


def centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives n x - S, as exact integers (64 bits where they surely suffice, else Python's)."""
    near = np.array([s // max(n, 1) for s in sums], np.int64)
    rest = np.array([s - int(m) * n for s, m in zip(sums, near)], object)

    def work(x: np.ndarray) -> np.ndarray:
        off = x - near
        if not off.size or int(np.abs(off).max()) * n < 2**61:
            return off * n - rest.astype(np.int64)
        return off.astype(object) * n - rest

    return work


def squares(exact: np.ndarray) -> np.ndarray:
    """Sums of squares by row, exact; an object array where 64 bits may not suffice."""
    rough = np.square(exact.astype(np.float64)).sum(1)
    if exact.dtype != object and rough.max(initial=0.0) < 9e18:
        return np.square(exact).sum(1)
    return np.square(exact.astype(object)).sum(1)


def whiten(df: DataFrame, components: int = 16, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Rows (``keep`` columns, component, n, deviation, whitened, explained, identity_error): the whitened value of each vector at each component.

    The fit list is written once to the folder of ``spark.checkpoint.dir``, so a lost executor repeats one task's part of one pass.
    """
    spark = df.sparkSession
    out = {"component", "n", "deviation", "whitened", "explained", "identity_error"}
    if clash := out & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = df.select(*keep, vector).where(usable(F.col(vector)))
    fit = Fit(rows.select(integers(F.col(vector)).alias("x")), f"{shared_folder(spark, 'whitening')}/fit")
    n, centre, trace = fit.n, fit.centre, fit.trace()
    values, vectors, explained, error = np.zeros(0), np.zeros((fit.size, 0)), np.zeros(0), 0.0
    if trace:
        values, vectors = block_lanczos(fit.multiply, fit.size, components)
        real = values > FLAT * values[0]
        values, vectors = values[real], vectors[:, real]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        explained = values / trace
        error = fit.identity_error(vectors / np.sqrt(values))
    turn, count = vectors / np.sqrt(values), len(values)
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kept + ', ' if keep else ''}component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kinds = arrow_schema(spark, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (batch.num_rows and count):
                continue
            exact = centre(matrix(batch.column(len(keep))))
            which = pa.array(np.repeat(np.arange(batch.num_rows), count))
            found = {name: batch.column(i).take(which) for i, name in enumerate(keep)}
            deviation = [int(v) if v < 2**63 else None for v in squares(exact).tolist()]
            found["component"] = np.tile(np.arange(1, count + 1), batch.num_rows)
            found["n"] = np.full(len(which), n)
            found["deviation"] = pa.array(deviation, pa.int64()).take(which)
            found["whitened"] = (exact.astype(np.float64) / n @ turn).ravel()
            found["explained"] = np.tile(explained, batch.num_rows)
            found["identity_error"] = np.full(len(which), error)
            yield record_batch(found, kinds)

    return rows.select(*keep, integers(F.col(vector)).alias("x")).mapInArrow(run, schema)
