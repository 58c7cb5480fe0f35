"""Uniform shuffle into shards of exact size with a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by one row at most. Let n_p be the rows of input partition p and c_s the capacity of shard s. Row p of the
matrix, how many of p's rows go to each shard, is drawn from the multivariate hypergeometric distribution over what is left
of the capacities, which is the law of a uniformly random assignment with exactly those capacities. Then every partition permutes its rows
where they are (a sort inside the partition by a random key), cuts the permutation by its row of the matrix, rows are exchanged once, and each shard
permutes what it received.

Everything that touches rows is DataFrame expressions. The driver draws the matrix from one count for each partition; more than ``MOST_GROUPS``
partitions are first dealt onto that many, so the matrix, which is broadcast, has at most ``MOST_GROUPS`` x shards numbers at any size of
the input. Draws are exact at any size: NumPy's generator below its limit of 1e9, beyond it rejection over Python integers with probabilities of 30 digits.
Hot keys don't matter: rows are placed by their position, never by a value.

Row positions come from a written table (checkpoint), so a lost executor can't change them.

Defined results: a null text counts as empty (size 8, crc32 0). Repeated rows are separate rows with slots of their own. An empty table
gives an empty result. Two runs over the same files and settings agree.
"""

from __future__ import annotations

import json
from decimal import Decimal, localcontext
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.batches import checkpointed, refuse_names

MOST_GROUPS = 4096
#: Rows that one local permutation should hold at most; it sets into how many slices a shard is cut.
SLICE_ROWS = 50_000


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts by (partition, shard): row sums are ``rows``, column sums differ by one at most."""
    total = sum(rows)
    left = np.full(shards, total // shards, np.int64)
    rng = np.random.default_rng(seed)
    left[rng.permutation(shards)[: total % shards]] += 1
    matrix = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        matrix[p] = multivariate(rng, left, n)
        left -= matrix[p]
    return matrix


#: NumPy draws exactly while both parts of a population are below this.
LIBRARY_LIMIT = 10**9


def multivariate(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows go to each shard, ``left`` being the free places: one conditional draw after the other."""
    if left.sum() < LIBRARY_LIMIT:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out, rest, need = np.zeros(len(left), np.int64), int(left.sum()), n
    for s, c in enumerate(map(int, left)):
        rest -= c
        out[s] = hypergeometric(rng, c, rest, need)
        need -= int(out[s])
    return out


def log_factorial(n: int) -> Decimal:
    """ln n! with an error below 1e-29 (the context must have 40 digits)."""
    if n < 1000:
        return Decimal(factorial(n)).ln()
    x, tau = Decimal(n), Decimal("6.283185307179586476925286766559005768394")
    return (x + Decimal("0.5")) * x.ln() - x + tau.ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good`` + ``bad``. The distribution is log-concave, so beyond the library's limit Devroye's universal rejection
    for such distributions draws it: a plateau with exponential tails around the mode, accepted by the ratio of probabilities."""
    if not (good and bad and drawn) or drawn == good + bad:
        return min(good, drawn) if drawn != good + bad else good
    if max(good, bad) < LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    with localcontext() as context:
        context.prec = 40

        def varying(k: int) -> Decimal:
            return -sum(map(log_factorial, (k, good - k, drawn - k, bad - drawn + k)))

        mode = (drawn + 1) * (good + 1) // (good + bad + 2)
        fixed = sum(map(log_factorial, (good, bad, drawn, good + bad - drawn))) - log_factorial(good + bad)
        top = varying(mode)
        peak = float((fixed + top).exp())
        w = 1 + peak / 2
        while True:
            y = rng.random() * w / peak if rng.random() <= w / (1 + w) else (w + rng.exponential()) / peak
            k = mode + (round(y) if rng.random() < 0.5 else -round(y))
            u = (int.from_bytes(rng.bytes(16), "big") + 1) / Decimal(2**128)
            if low <= k <= high and u.ln() + min(Decimal(0), Decimal(w - peak * y)) <= varying(k) - top:
                return k


def local_table(df: DataFrame, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from driver values, as a JSON literal that Spark parses itself."""
    one = df.sparkSession.range(1)
    return one.select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def mixed(seed: int, *columns: Column) -> Column:
    """A hash of 63 bits, never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def shuffle(df: DataFrame, shards: int = 24, seed: int = 11, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to the rows of ``df``; columns of these names are replaced, all
    others are kept. Names that begin with two underscores are the operator's own, and columns with one of those it uses are an error."""
    if shards < 1:
        raise ValueError("at least one shard")
    refuse_names(tuple(df.columns), {"__at", "__key", "__g", "__cuts", "__rank", "__slice", "__s", "__q", "__offset"})
    row = (1 << 33) - 1  # an id is the partition's number in the upper 31 bits, the row's number in it below
    placed = checkpointed(df.drop("shard", "slot"))
    if placed.select(F.spark_partition_id().alias("p")).distinct().count() > MOST_GROUPS:
        placed = checkpointed(placed.repartition(MOST_GROUPS))
    counts = {r[0]: r[1] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()}  # at most MOST_GROUPS rows
    groups = sorted(counts)
    matrix = communication_matrix([counts[g] for g in groups], shards, seed)
    total = sum(counts.values())
    cuts = local_table(df, [{"__g": g, "__cuts": np.cumsum(m).tolist()} for g, m in zip(groups, matrix)], "__g bigint, __cuts array<bigint>")
    # first permutation, inside each partition and without an exchange; the hash of the position is the random key
    first = placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__key", mixed(seed, F.col("__at")))
    first = first.sortWithinPartitions("__key", "__at").withColumn("__rank", F.monotonically_increasing_id().bitwiseAND(F.lit(row)))
    sent = first.join(F.broadcast(cuts), F.shiftright("__at", 33) == F.col("__g"))
    sent = sent.withColumn("shard", F.size(F.filter("__cuts", lambda c: c <= F.col("__rank")))).drop("__rank", "__key", "__g", "__cuts")
    # second permutation, inside each shard: slices of the key's range keep the order and bound what one task sorts
    slices = max(1, -(-total // (shards * slice_rows)))
    sent = sent.withColumn("__key", mixed(seed + 1, F.col("__at")))
    sent = sent.withColumn("__slice", F.expr(f"int(__key div {2**63 // slices + 1})"))
    if slices == 1:
        return sent.withColumn("slot", (F.row_number().over(Window.partitionBy("shard").orderBy("__key", "__at")) - 1).cast("long")).drop("__at", "__key", "__slice")
    before = Window.partitionBy("__s").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy(F.col("shard").alias("__s"), F.col("__slice").alias("__q")).count().select("__s", "__q", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    ranked = sent.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__slice").orderBy("__key", "__at")) - 1)
    joined = ranked.join(offsets, (F.col("shard") == F.col("__s")) & (F.col("__slice") == F.col("__q")))
    return joined.withColumn("slot", (F.col("__offset") + F.col("__rank")).cast("long")).drop("__at", "__key", "__slice", "__rank", "__s", "__q", "__offset")


def shard_documents(df: DataFrame, shards: int = 24, seed: int = 11, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Size, checksum, shard and slot of every document; the texts stay where they are."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = df.select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle(narrow, shards, seed, slice_rows)
