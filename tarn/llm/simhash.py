"""Near-duplicates by SimHash: pigeonhole blocks, a join on blocks, then exact Hamming distances.

Fingerprints of 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most ``MOST_BITS`` bits differ in at most that
many blocks, so they agree on all the others: every choice of ``BLOCKS - MOST_BITS`` blocks gives one join key (20 keys of about
32 bits), and each close pair meets under at least one of them. Inside a key, distances are exact.

Equal fingerprints are one node of the graph, so thousands of copies are one row. Under one key a task emits a
spanning forest of the close pairs, never the pairs themselves: it walks from fingerprint to fingerprint over what is not yet reached, so a dense
group costs time in proportion to its size. A key with very many fingerprints that are far apart is searched by looking up all
fingerprints within the distance instead of comparing all pairs; both are exact.

Defined results: text without words (null, empty, blanks) has fingerprint 0, linked like any other. Repeated rows share all results.
An empty table gives an empty result. A null doc_id is never a component's id unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import checkpointed, map_rows
from tarn.llm.graph import components

SEED = 42
SHINGLE = 3
MOST_BITS = 3
BLOCKS = 6
#: Above this many fingerprints under one key, neighbours are looked up instead of compared.
LOOK_UP_ABOVE = 150_000


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over).view(">i8")[0])


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp`` (long)."""

    def work(*columns: list) -> dict:
        return dict(zip(keep, columns)) | {"fp": [fingerprint(t) for t in columns[-1]]}

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(df, [*keep, text], work, f"{kept}, fp bigint")


def block_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """For each choice of blocks that must agree, the bits of those blocks, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - most)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def forest(fps: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a spanning forest of the pairs of distinct fingerprints within the distance."""
    if len(fps) > LOOK_UP_ABOVE:
        return look_up_forest(fps, most)
    left = np.arange(len(fps))
    values = fps.copy()
    a, b = [], []
    queue: list[int] = []
    while len(left):
        if queue:
            i = queue.pop()
        else:
            i, left, values = int(left[-1]), left[:-1], values[:-1]
        near = np.bitwise_count(values ^ fps[i]) <= most
        if near.any():
            found = left[near]
            a.append(np.full(len(found), i))
            b.append(found)
            queue += found.tolist()
            left, values = left[~near], values[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def look_up_forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by looking up every fingerprint within the distance; all under one key agree outside ``free`` bits."""
    order = np.argsort(fps)
    ordered = fps[order]
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [1 << b for b in range(64) if varying >> b & 1]
    masks = np.array([sum(c) for k in range(1, most + 1) for c in combinations(free, k)], np.uint64)
    reached = np.zeros(len(fps), bool)
    a, b = [], []
    for seed in range(len(fps)):
        if reached[seed]:
            continue
        reached[seed] = True
        queue = [seed]
        while queue:
            i = queue.pop()
            wanted = ordered[i] ^ masks
            at = np.minimum(np.searchsorted(ordered, wanted), len(fps) - 1)
            at = at[(ordered[at] == wanted) & ~reached[at]]
            reached[at] = True
            a.append(np.full(len(at), i))
            b.append(at)
            queue += at.tolist()
    return order[np.concatenate(a)], order[np.concatenate(b)]


def close_edges(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (u, v) between representatives whose fingerprints are close: a spanning forest for each block key.

    ``distinct`` has one row (fp, rep) for each fingerprint."""
    masks = block_masks(BLOCKS, most)
    keys = F.array(*(F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keyed = distinct.select("fp", "rep", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp", "rep")
    grouped = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the key that the last batch ended in

        def edges(columns: list[np.ndarray]) -> pa.RecordBatch | None:
            choice, key, fp, rep = columns
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            u, v = [], []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                i, j = forest(fp[a:b].view(np.uint64), most)
                u.append(rep[a:b][i])
                v.append(rep[a:b][j])
            if not u:
                return None
            return pa.record_batch([pa.array(np.concatenate(u), pa.int64()), pa.array(np.concatenate(v), pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            alone = columns[0][0] == columns[0][-1] and columns[1][0] == columns[1][-1]
            goes_on = held and held[-1][0][-1] == columns[0][0] and held[-1][1][-1] == columns[1][0]
            held.append(columns)
            if alone and goes_on:
                continue  # the same key throughout: go on gathering
            whole = [np.concatenate(c) for c in zip(*held)]
            same = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])
            first = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if first and (out := edges([c[:first] for c in whole])) is not None:
                yield out
            held = [tuple(c[first:] for c in whole)]
        if held and (out := edges([np.concatenate(c) for c in zip(*held)])) is not None:
            yield out

    return grouped.mapInArrow(run, "u bigint, v bigint")


def clusters(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(f, cluster, component_id) of each fingerprint in ``distinct`` (fp, rep: its smallest id): the smallest fingerprint and id of its component."""
    labels = checkpointed(components(close_edges(distinct.select("fp", F.col("fp").alias("rep")), most)))
    least = distinct.join(labels, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "c")
    named = labels.join(least, F.col("component") == F.col("c")).select("node", "component", "least")
    ids = distinct.join(named, F.col("fp") == F.col("node"), "left")
    # written once, so that a join of rows with it is a plain one whose hot fingerprints Spark can split over tasks
    return checkpointed(ids.select(F.col("fp").alias("f"), F.coalesce("component", "fp").alias("cluster"), F.coalesce("least", "rep").alias("component_id")))


def labelled(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """The ``keep`` columns (with doc_id), ``fp``, ``cluster`` (the smallest fingerprint of the component) and ``component_id`` of every row.
    Fingerprints are the nodes, so rows without an id link others too."""
    hashed = checkpointed(fingerprints(df, keep, text))
    distinct = checkpointed(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    return hashed.join(clusters(distinct, most), F.col("fp") == F.col("f")).select(*keep, "fp", "cluster", "component_id")


def firsts(hashed: DataFrame, order: list[Column], most: int = MOST_BITS) -> DataFrame:
    """The row of ``hashed`` (fp and the columns of ``order``) that comes first by ``order`` in each component. Rows meet as minima by
    fingerprint, so thousands of copies are one row of every join."""
    distinct = checkpointed(hashed.groupBy("fp").agg(F.min(F.struct(*order)).alias("best")))
    found = clusters(distinct.select("fp", F.lit(None).cast("long").alias("rep")), most)
    return distinct.join(found, F.col("fp") == F.col("f")).groupBy("cluster").agg(F.min("best").alias("best")).select("best.*")


def group(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """The ``keep`` columns (with doc_id), ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    return labelled(df, keep, text, most).select(*keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
