"""Near-duplicates of a stated similarity, by SimHash blocks over dealt shingles, Hamming distances and the shingles themselves.

Two texts are near-duplicates if their sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more. One 64-bit fingerprint can't be cut into blocks for that: at 0.8 it
differs in about ten bits, more than any choice of few blocks forgives. So the shingles themselves are dealt, by their hash, into parts of one and a half to three shingles, each part has
a SimHash fingerprint of its own, and a block is one part (short texts) or two: close texts differ in few shingles, so they share blocks whole. ``BLOCKS`` blocks are kept of each text, the same
ones of every text with as many parts; the number of parts follows the number of shingles, and a text near a change of that number has the blocks of both.

Texts with the same set of shingles are one node. Nodes meet by block: each is compared with the smallest node that it shares most blocks with, first by the Hamming distance of the
whole texts' fingerprints, then by the shingles. What isn't close to that node goes into the next of ``ROUNDS`` rounds, without it. Then groups meet: ``MERGES`` nodes are drawn in each block, and every
node is compared with up to that many of other groups, so the groups of a large cluster grow together before its pairs are formed. These steps only
save work: last, all nodes that share a block and are in different groups by then are compared, so no two texts with a block in common, fingerprints within ``CLOSE_BITS`` and the similarity stay in
different groups. Only blocks with several groups are multiplied with themselves, in chunks, and the shingles of nodes without company are never gathered.

Defined results: a text with fewer words than a shingle has its whole sequence as its one shingle, texts without words (null, empty, blanks) are equal to each other. Repeated rows and null ids
are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.batches import checkpointed, map_rows, shared_folder, shuffles_removed
from tarn.llm.graph import components

SEED = 42
SHINGLE, SIMILARITY = 5, 0.8
BLOCKS = 16
#: Shingles of a part at least, and parts up to which a block is a single one.
PART, SINGLE = 1.5, 16
#: Bits in which fingerprints of close texts may differ; at 0.8 it is 10 with a deviation of 3.
CLOSE_BITS = 24
#: Rounds in which nodes meet one other each, and nodes of a block that are drawn for those of other groups; what they leave is compared pair by pair.
ROUNDS, MERGES = 3, 4
#: Nodes of a block that one task holds while others pass by.
CHUNK = 2000
SETS = "node bigint, shingles array<bigint>, size int, parity array<bigint>"
#: Words of 64 bits, as a power of two, of the map that tells which texts may be wanted.
MAP_BITS = 17


def shingles(text: str | None) -> np.ndarray:
    """The text's distinct shingle hashes, rising; A-Z is lower-cased, words are parted by ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def simhash(hashes: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """The fingerprint of each part: bits set in over half of its hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    upto = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(bits[order], axis=0)])[np.r_[0, np.cumsum(sizes)]]
    return np.packbits(2 * np.diff(upto, axis=0) > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """256 bits: for each low byte whether an odd number of the shingles has it. Two texts' parities differ in no more bits than their sets differ in shingles."""
    return np.packbits(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) % 2 == 1).view(">i8").astype(np.int64)


def levels(n: int) -> list[int]:
    """Powers of two of the numbers of parts of a text with n shingles: its own and that of a close text with more shingles."""
    own = lambda m: max(0, int(np.floor(np.log2(m / PART))))
    return sorted({own(n), own(n / SIMILARITY)}) if n else []


def blocks(hashes: np.ndarray) -> list[int]:
    """Keys, as signed numbers, of a text's blocks. Blocks with a single shingle are left out where the text has more."""
    out = []
    for level in levels(len(hashes)):
        parts = 1 << level
        width = 1 if parts <= SINGLE else 2
        kept = min(parts, BLOCKS * width)
        part = (hashes >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(hashes), np.int64)
        inside = part < kept
        prints, sizes = simhash(hashes[inside], part[inside], kept), np.bincount(part[inside], minlength=kept)
        for j in range(0, kept, width):
            if sizes[j : j + width].sum() > (1 if len(hashes) > 2 else 0):
                out.append(xxhash.xxh64_intdigest(np.r_[np.uint64(level), np.uint64(j), prints[j : j + width]].tobytes()))
    return [k - 2**64 if k >= 2**63 else k for k in out]


def sketch(text: str | None) -> tuple[int, int, int, list[int]]:
    """Two hashes of the set of shingles, the fingerprint of the whole, and the keys of the blocks."""
    found = shingles(text)
    data = found.tobytes()
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    whole = int(simhash(found, np.zeros(len(found), np.int64), 1)[0]) if len(found) else 0
    return signed(xxhash.xxh64_intdigest(data, 1)), signed(xxhash.xxh64_intdigest(data, 2)), signed(whole), blocks(found)


def sketches(df: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The ``keep`` columns, set_1 and set_2 (hashes of the set of shingles), fp and blocks."""

    def work(*columns: list) -> dict:
        found = [sketch(t) for t in columns[-1]]
        return dict(zip(keep, columns)) | {name: [f[i] for f in found] for i, name in enumerate(("set_1", "set_2", "fp", "blocks"))}

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(df, [*keep, text], work, f"{kept}, set_1 bigint, set_2 bigint, fp bigint, blocks array<bigint>")


class Tables:
    """Tables of one run, below a folder that all executors share. Small ones are read again by few tasks, so what follows has few shuffle files, and none has a lineage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.numbers = spark, folder, itertools.count()

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/table-{next(self.numbers)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def near_edges(rows: DataFrame, nodes: DataFrame, key: tuple[str, ...], folder: str) -> DataFrame:
    """(u, v) of near-duplicates among ``nodes`` (node, fp, blocks and the ``key`` of one of their rows), verified on the texts of ``rows``, which has each key once. What is found links every
    group of close texts, not every pair in it."""
    return functools.reduce(DataFrame.unionByName, near_groups(rows, nodes, key, Tables(rows.sparkSession, folder))[0])


def near_groups(rows: DataFrame, nodes: DataFrame, key: tuple[str, ...], table: Tables) -> tuple[list[DataFrame], DataFrame]:
    """The parts of :func:`near_edges` and the (node, component) that they make."""
    placed = nodes.select("node", "fp", F.explode("blocks").alias("block"))
    company = table(placed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select(F.col("block").alias("b")))
    left = table(placed.join(company, F.col("block") == F.col("b"), "left_semi"))
    wanted = nodes.join(left.select(F.col("node").alias("m")).distinct(), F.col("node") == F.col("m"), "left_semi").select("node", *key)
    sets = table(sets_of(rows, wanted, key))
    met, edges = left, []
    for i in range(ROUNDS):
        pairs = table(centres(left, table))
        edges.append(table(verified(pairs, sets)))
        if i == ROUNDS - 1:
            break
        # linked nodes and the nodes that the others were compared with are done; a block with one node is, too
        done = edges[-1].select(F.col("u").alias("d")).union(pairs.select(F.col("v").alias("d"))).distinct()
        rest = table(left.join(done, F.col("node") == F.col("d"), "left_anti"))
        shared = rest.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select(F.col("block").alias("b"))
        left = table(rest.join(shared, F.col("block") == F.col("b"), "left_semi"))
        if left.isEmpty():
            break
    labels = table(components(functools.reduce(DataFrame.unionByName, edges), table))
    if MERGES:
        edges.append(table(verified(drawn(labelled(met, labels), table), sets)))
        labels = grown(labels, edges[-1], table)
    edges.append(table(verified(apart(labelled(met, labels), sets), sets)))
    return edges, grown(labels, edges[-1], table)


def grown(labels: DataFrame, edges: DataFrame, table: Tables) -> DataFrame:
    """The labels with more edges."""
    if edges.isEmpty():
        return labels
    return table(components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edges), table))


def labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of the blocks with the group of each; a node without a label is a group of its own."""
    named = labels.withColumnRenamed("node", "l")
    return met.join(named, F.col("node") == F.col("l"), "left").select("node", "fp", "block", F.coalesce("component", "node").alias("group"))


def centres(met: DataFrame, table: Tables) -> DataFrame:
    """(u, v): each node with the smallest node of a block, of the one that it shares most blocks with, if their fingerprints are close."""
    # written, so that the nodes of a hot block stay where they are or are split
    least = table(met.groupBy("block").agg(F.min(F.struct("node", "fp")).alias("least")).withColumnRenamed("block", "b"))
    shared = met.join(least, F.col("block") == F.col("b")).where(F.col("node") > F.col("least.node"))
    shared = shared.groupBy(F.col("node").alias("u"), F.col("least.node").alias("v")).agg(F.count("*").alias("n"), F.first(distance(F.col("fp"), F.col("least.fp"))).alias("bits"))
    best = shared.where(F.col("bits") <= CLOSE_BITS).groupBy("u").agg(F.max(F.struct("n", -F.col("bits"), -F.col("v"))).alias("best"))
    return best.select("u", (-F.col("best.col3")).alias("v"))


def drawn(grouped: DataFrame, table: Tables) -> DataFrame:
    """(u, v): each node with nodes of other groups. ``MERGES`` times a node is drawn by hash in each block; of those drawn at one time in its blocks, a node meets the one with the closest fingerprint. At most
    ``MERGES`` pairs a node, however large its blocks are."""
    pivots = [F.min_by(F.struct("node", "fp", "group"), F.xxhash64(F.lit(turn), "node")).alias(f"p{turn}") for turn in range(MERGES)]
    mixed = grouped.groupBy("block").agg(F.min("group").alias("low"), F.max("group").alias("high"), *pivots).where("low < high")
    mixed = table(mixed.withColumnRenamed("block", "b").drop("low", "high"))

    def closest(turn: int) -> Column:
        pivot, bits = F.col(f"p{turn}"), distance(F.col("fp"), F.col(f"p{turn}.fp"))
        return F.min(F.when((F.col("group") != pivot["group"]) & (bits <= CLOSE_BITS), F.struct(bits.alias("bits"), pivot["node"].alias("node"))))

    met = grouped.join(mixed, F.col("block") == F.col("b")).groupBy(F.col("node").alias("u")).agg(*(closest(turn).alias(f"p{turn}") for turn in range(MERGES)))
    found = met.select("u", F.explode(F.array_compact(F.array(*(F.col(f"p{turn}.node") for turn in range(MERGES))))).alias("v"))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def apart(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): all pairs of nodes of different groups that share a block, if their fingerprints are close, but for those whose sizes or parities alone show that their shingles aren't. A block of
    more than ``CHUNK`` nodes is dealt by hash into chunks; each of its nodes meets the chunks one by one, so a task's memory is that of a chunk and a block of very many nodes lies in several tasks.
    Blocks with a single group have nothing to compare."""
    mixed = grouped.groupBy("block").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    mixed = checkpointed(mixed.select(F.col("block").alias("b"), F.ceil(F.col("n") / CHUNK).alias("chunks")))
    placed = grouped.join(mixed, F.col("block") == F.col("b")).join(sets.select(F.col("node").alias("s"), "size", "parity"), F.col("node") == F.col("s"))
    columns = ("node", "fp", "block", "group", "size", "parity")
    ones = placed.select(*(F.col(c).alias(f"{c}_1") for c in columns), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk_1"))
    others = placed.select(*columns, F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    met = ones.join(others, (F.col("block_1") == F.col("block")) & (F.col("chunk_1") == F.col("chunk")))
    met = met.where((F.col("node_1") > F.col("node")) & (F.col("group_1") != F.col("group")) & (distance(F.col("fp_1"), F.col("fp")) <= CLOSE_BITS))
    total = F.col("size_1") + F.col("size")
    differing = functools.reduce(Column.__add__, (distance(F.get("parity_1", F.lit(i)), F.get("parity", F.lit(i))) for i in range(4)))
    # of sets with a similarity s, (1 - s) / (1 + s) of all their members, counted in both, are in one only
    met = met.where((F.least("size_1", "size") >= SIMILARITY * F.greatest("size_1", "size")) & (differing * (1 + SIMILARITY) <= (1 - SIMILARITY) * total + 1e-6))
    return met.select(F.col("node_1").alias("u"), F.col("node").alias("v")).distinct()


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sets_of(rows: DataFrame, wanted: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(node, shingles) of the wanted nodes' texts. A map of fixed size keeps the other texts out of the shuffle; the join is exact."""
    place = F.xxhash64(*key)
    bucket = F.shiftrightunsigned(place, 64 - MAP_BITS)
    names = ", ".join(key)
    words = wanted.groupBy(bucket.alias("bucket")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64({names}) & 63 as int))")).alias("word"))
    maybe = rows.select(*key, "text").withColumn("bucket", bucket).withColumn("bit", place.bitwiseAND(63).cast("int"))
    maybe = maybe.join(F.broadcast(words), "bucket").where("getbit(word, bit) = 1").select(*key, "text")  # at most 2^MAP_BITS words
    texts = maybe.join(wanted, list(key)).select("node", "text")

    def work(node, found: list) -> dict:
        own = [shingles(t) for t in found]
        return {"node": node, "shingles": [x.view(np.int64) for x in own], "size": [len(x) for x in own], "parity": [parity(x) for x in own]}

    return map_rows(texts, ["node", "text"], work, SETS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingles are similar enough."""
    own = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(own, F.col("u") == F.col("a")).join(other, F.col("v") == F.col("b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select("u", "v")


def firsts(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``key`` of the row that comes first by ``order`` (null last, then by key) in each group of near-duplicates of ``rows`` (key, order, text)."""
    spark = rows.sparkSession
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*key, *order)}
    rank = F.struct(*(c for o in order for c in (F.col(o).isNull(), F.col(o))), *key)
    with shuffles_removed(spark):
        table = Tables(spark, shared_folder(spark, "near-duplicates"))
        made = table(sketches(rows, tuple(kinds)))
        same = made.groupBy("set_1", "set_2").agg(F.min_by(F.struct(*kinds), rank).alias("best"), F.first("fp").alias("fp"), F.first("blocks").alias("blocks"))
        # numbers are given once, as the table is written
        nodes = table(same.select(F.monotonically_increasing_id().alias("node"), "best.*", "fp", "blocks"))
        if not made.groupBy(*key).count().where("count > 1").isEmpty():
            rows = rows.dropDuplicates(list(key))  # rows that agree in their key agree in everything; seldom, so texts are only shuffled for it if need be
        labels = near_groups(rows, nodes, key, table)[1].withColumnRenamed("node", "n")
    named = nodes.join(labels, F.col("node") == F.col("n"), "left").select(F.coalesce("component", "node").alias("group"), F.struct(*key).alias("key"), rank.alias("rank"))
    return named.groupBy("group").agg(F.min_by("key", "rank").alias("key")).select("key.*")
