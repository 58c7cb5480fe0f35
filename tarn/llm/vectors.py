"""Nearest neighbours by inner product with vantage-point trees, one for each shard of the vectors.

Largest inner product is turned into smallest Euclidean distance: with M the largest norm of a tree, x becomes (x, sqrt(M^2 - |x|^2)) and a query
(q, 0), so |q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors whose norms differ by more than a factor of 2 go into separate trees, so M fits its tree. A tree node keeps a vantage point and the range of distances on either side; a side is skipped if the
triangle inequality puts it beyond the k-th best so far, ``lower bound * factor > k-th distance``. Factor 1 is exact search;
larger factors prune more. Distances only choose what to score: every point within a bound on their rounding of the k-th is scored
exactly and ranked by that score, then by id. Queries go down the tree as a batch: first each to its own leaf, which gives a good k-th distance, then once
over all nodes with the queries that can't skip them.

Shards are dealt by a hash of id and vector and hold a bounded number of rows. A shard's rows come before its queries in its partition, so its trees are built once and
queries stream through them batch by batch: no task holds all vectors or all queries. Each batch gives the k best of its queries; a second step merges k rows for each
shard and query. Equal vectors of a shard are one point of its tree with its smallest ids (k, and as many as a query has rows of its own), so thousands of
copies neither unbalance a tree nor crowd out a result.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take no part; vectors of different lengths are
never compared. A query is not its own candidate, nor is any other row with its id. Rows with a null id are candidates, after all others in ties, but no queries; the largest long, which stands for
null in between, must not be an id. Ties go to the smaller id. With fewer than k candidates all are
returned; an empty table gives an empty result. Scores are sums over the dimensions in order, in double precision, of the stored numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm.batches import bounded_batches

#: Rows of a shard at most, and how many shards smaller tables get, so that they spread over the cluster.
SHARD_ROWS, SPREAD, LEAST_ROWS = 32_768, 32, 512
LEAF = 128
#: Pairs scored at a time, and what keeps bounds on rounding above 0 where squares underflow.
PAIRS, TINY = 1 << 15, 1e-300


def rounding(dimensions: int) -> float:
    """A bound on the rounding of inner products, norms and lifted distances, as a part of the sum of both squared norms."""
    return 8 * (dimensions + 4) * float(np.finfo(np.float64).eps)


class Tree:
    """A vantage-point tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (start, end) of a leaf, or (vantage, near range, far range, near child, far child)
        self.rng = np.random.default_rng(seed)
        self.root = self.build(0, len(points)) if len(points) else -1

    def build(self, start: int, end: int) -> int:
        me = len(self.nodes)
        self.nodes.append((start, end))
        if end - start <= self.leaf:
            return me
        at = int(self.rng.integers(start, end))
        order = self.order
        order[start], order[at] = order[at], order[start]
        rest = order[start + 1 : end]
        d = np.sqrt(((self.points[rest] - self.points[order[start]]) ** 2).sum(1))
        half = len(rest) // 2  # by rank, so equal distances can't unbalance the tree
        split = np.argpartition(d, half)
        order[start + 1 : end], d = rest[split], d[split]
        near, far = (d[:half].min(), d[:half].max()), (d[half:].min(), d[half:].max())
        self.nodes[me] = (int(order[start]), near, far, self.build(start + 1, start + 1 + half), self.build(start + 1 + half, end))
        return me

    def walk(self, queries: np.ndarray, offer: Callable, radius: Callable, factor: float = 1.0) -> None:
        """Calls ``offer(rows, points, d)`` with squared distances of all points that may be within ``radius(rows)`` (squared) of the queries
        in ``rows``, each pair once; the radius may shrink between calls."""
        if self.root < 0 or not len(queries):
            return
        norms = (queries**2).sum(1)
        squares = (self.points**2).sum(1)
        relative = rounding(self.points.shape[1])
        slack = relative * (norms + squares.max()) + TINY

        def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
            return np.maximum(norms[rows, None] + squares[points] - 2 * queries[rows] @ self.points[points].T, 0)

        # each query's own leaf
        own = np.full(len(queries), -1)
        ways = [(self.root, np.arange(len(queries)))]
        while ways:
            node, rows = ways.pop()
            if len(self.nodes[node]) == 2:
                own[rows] = node
                points = self.order[slice(*self.nodes[node])]
                offer(rows, points, distances(rows, points))
                continue
            v, near, far, left, right = self.nodes[node]
            inside = np.sqrt(distances(rows, np.array([v]))[:, 0]) <= (near[1] + far[0]) / 2
            ways += [(child, part) for child, part in ((left, rows[inside]), (right, rows[~inside])) if len(part)]
        # all others that can't be skipped
        ways = [(self.root, np.arange(len(queries)))]
        while ways:
            node, rows = ways.pop()
            if len(self.nodes[node]) == 2:
                rows = rows[own[rows] != node]
                if len(rows):
                    points = self.order[slice(*self.nodes[node])]
                    offer(rows, points, distances(rows, points))
                continue
            v, near, far, left, right = self.nodes[node]
            square = distances(rows, np.array([v]))
            offer(rows, np.array([v]), square)
            square, off = square[:, 0], slack[rows]
            least, most, reach = np.sqrt(np.maximum(square - off, 0)), np.sqrt(square + off), np.sqrt(np.maximum(radius(rows), 0) + off)
            for (low, high), child in ((near, left), (far, right)):
                bound = np.maximum(np.maximum(least - high * (1 + relative), low * (1 - relative) - most), 0)
                part = rows[~(bound * factor > reach * (1 + 1e-9))]
                if len(part):
                    ways.append((child, part))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and positions of the k nearest points of each query (unsorted; position -1: fewer points)."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1)

        def offer(rows: np.ndarray, points: np.ndarray, d: np.ndarray) -> None:
            better = (d < best[rows].max(1)[:, None]).any(1)
            if better.any():
                rows, d = rows[better], d[better]
                all_d = np.concatenate([best[rows], d], 1)
                all_i = np.concatenate([found[rows], np.broadcast_to(points, d.shape)], 1)
                keep = np.argpartition(all_d, k - 1, 1)[:, :k]
                best[rows] = np.take_along_axis(all_d, keep, 1)
                found[rows] = np.take_along_axis(all_i, keep, 1)

        self.walk(queries, offer, lambda rows: best[rows].max(1), factor)
        return best, found


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the dimensions, so equal vectors get equal scores."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * points[:, j]
    return total


class Best:
    """The best points of each query so far by exact score, then by position."""

    def __init__(self, queries: np.ndarray, points: np.ndarray, most: int):
        self.queries, self.points, self.most = queries, points, most
        self.score = np.full((len(queries), most), -np.inf)
        self.point = np.full((len(queries), most), len(points))
        self.last, self.place = np.full(len(queries), -np.inf), np.full(len(queries), len(points))  # of the worst one kept

    def offer(self, q: np.ndarray, p: np.ndarray) -> None:
        for i in range(0, len(q), PAIRS):
            self.merge(q[i : i + PAIRS], p[i : i + PAIRS])

    def merge(self, q: np.ndarray, p: np.ndarray) -> None:
        s = scores(self.queries[q], self.points[p])
        better = (s > self.last[q]) | ((s == self.last[q]) & (p < self.place[q]))
        q, p, s = q[better], p[better], s[better]
        if not len(q):
            return
        by = np.argsort(q, kind="stable")
        q, p, s = q[by], p[by], s[by]
        rows, start, n = np.unique(q, return_index=True, return_counts=True)
        at = (np.repeat(np.arange(len(rows)), n), self.most + np.arange(len(q)) - np.repeat(start, n))
        all_s, all_p = np.full((len(rows), self.most + n.max()), -np.inf), np.full((len(rows), self.most + n.max()), len(self.points))
        all_s[:, : self.most], all_p[:, : self.most] = self.score[rows], self.point[rows]
        all_s[at], all_p[at] = s, p
        order = np.argpartition(-all_s, self.most - 1, 1)
        ranked = np.take_along_axis(all_s, order, 1)
        tied = np.flatnonzero(ranked[:, self.most - 1] == ranked[:, self.most :].max(1))  # positions decide
        order[tied] = np.lexsort((all_p[tied], -all_s[tied]), axis=1)
        keep = order[:, : self.most]
        top_s, top_p = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_p, keep, 1)
        self.score[rows], self.point[rows] = top_s, top_p
        self.last[rows] = top_s.min(1)
        self.place[rows] = np.where(top_s == self.last[rows, None], top_p, -1).max(1)


class Band:
    """The points of a shard whose norms are within a factor of 2, lifted into one tree when a query first needs it."""

    def __init__(self, points: np.ndarray, members: np.ndarray):
        self.members, self.squares = members, (points[members] ** 2).sum(1)
        self.top, self.points, self.tree = self.squares.max(), points, None

    def search(self, best: Best, factor: float) -> None:
        """Offers ``best`` every point of the band that may be among its queries' best."""
        members, top, relative = self.members, self.top, rounding(self.points.shape[1] + 1)
        norms = (best.queries**2).sum(1)
        # scaled by powers of two (exact) to about the band's norm, so neither swallows the other in a distance
        shift = (np.frexp(top)[1] - np.frexp(norms)[1]) // 2
        # a score that even the longest vector of the band in the query's direction can't reach
        reachable = ~(np.sqrt(norms) * np.sqrt(top) * (1 + relative) + TINY < best.last)
        asked = np.flatnonzero(reachable)
        if not len(asked):
            return
        queries = np.ldexp(best.queries[asked], shift[asked, None])
        norms = (queries**2).sum(1)
        slack = relative * (norms + top) + TINY
        if self.tree is None:
            self.tree = Tree(np.concatenate([self.points[members], np.sqrt(np.maximum(top - self.squares, 0))[:, None]], 1), LEAF)

        def radius(rows: np.ndarray) -> np.ndarray:
            return norms[rows] + top - 2 * np.ldexp(best.last[asked[rows]], shift[asked[rows]])

        def offer(rows: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
            limit = radius(rows) + slack[rows]
            if len(at) > best.most:  # that many points of these alone are nearer than the rest
                open_ = np.isinf(limit)
                limit[open_] = np.partition(d[open_], best.most - 1, 1)[:, best.most - 1] + 2 * slack[rows[open_]]
            i, j = np.nonzero(~(d > limit[:, None]))
            best.offer(asked[rows[i]], members[at[j]])

        self.tree.walk(np.concatenate([queries, np.zeros((len(queries), 1))], 1), offer, radius, factor)


class Shard:
    """The stored vectors of a shard, ready to be searched by any number of query batches."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        distinct, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.reshape(-1)
        self.by_point = np.argsort(where, kind="stable")  # ids stay in order inside a point
        starts = np.searchsorted(where[self.by_point], np.arange(len(distinct)))
        counts = np.diff(np.append(starts, len(ids)))
        by_id = np.argsort(self.by_point[starts])  # points in the order of their smallest ids, so ties go to the smaller position
        self.distinct, self.starts, self.counts = distinct[by_id], starts[by_id], counts[by_id]
        band = np.frexp((self.distinct**2).sum(1))[1] // 2
        self.bands = [Band(self.distinct, np.flatnonzero(band == b)) for b in np.unique(band)[::-1].tolist()]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the k best for each query."""
        ids, distinct = self.ids, self.distinct
        # a query's own rows are dropped at the end, so as many more are kept
        own = ids[np.isin(ids, query_ids)]
        most = k + (int(np.unique(own, return_counts=True)[1].max()) if len(own) else 0)
        best = Best(queries, distinct, min(most, len(distinct)))
        for band in self.bands:
            band.search(best, factor)
        q = np.repeat(np.arange(len(queries)), best.most)
        p, s = best.point.reshape(-1), best.score.reshape(-1)
        q, p, s = q[p < len(distinct)], p[p < len(distinct)], s[p < len(distinct)]
        n = np.minimum(self.counts, most)[p]
        q, s, first = np.repeat(q, n), np.repeat(s, n), np.repeat(self.starts[p], n)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        got = ids[self.by_point[first + nth]]
        other = got != query_ids[q]
        q, s, got = q[other], s[other], got[other]
        rank = np.lexsort((got, -s, q))
        q, s, got = q[rank], s[rank], got[rank]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        return query_ids[q[top]], got[top], s[top]


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the k best of one shard for each query."""
    if not len(ids) or not len(query_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return Shard(ids, vectors).search(query_ids, queries, k, factor)


def stream(batches: Iterable[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Batches of (shard, size, q, id, v), sorted so that the stored rows of a shard come before its queries."""
    key, stored, shard = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        number, size, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        vectors = batch.column(4)
        cuts = np.flatnonzero((number[1:] != number[:-1]) | (size[1:] != size[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if (number[a], size[a]) != key:
                key, stored, shard = (number[a], size[a]), [], None
            part = (ids[a:b], vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
            if not asks[a]:
                stored.append(part)
                continue
            if shard is None and stored:
                shard, stored = Shard(*(np.concatenate(c) for c in zip(*stored))), []
            if shard is not None:
                found = shard.search(*part, k, factor)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def usable(column: str) -> Column:
    """Vectors that take part."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score: the k best of all rows for each row where ``is_query`` holds."""
    number, none = F.col(id_column).cast("long"), F.lit(2**63 - 1).cast("long")
    asks = F.coalesce(is_query, F.lit(False)) & number.isNotNull()
    rows = df.where(usable(vector)).select(F.coalesce(number, none).alias("id"), F.col(vector).cast("array<double>").alias("v"), asks.alias("q"))
    bounded_batches(df.sparkSession)
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS), min(SPREAD, -(-total // LEAST_ROWS)))
    deal = F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(shards)).cast("int")
    stored = rows.select(deal.alias("shard"), F.size("v").alias("size"), F.lit(False).alias("q"), "id", "v")
    queries = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("size"), "q", "id", "v")
    dealt = stored.union(queries).repartition(shards, "shard").sortWithinPartitions("shard", "size", "q", "id")
    found = dealt.mapInArrow(lambda batches: stream(batches, k, factor), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", none).alias("vec_id"), "score")
