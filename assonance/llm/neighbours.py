"""Nearest vectors by vantage-point trees, one per shard.

Largest inner product becomes smallest distance by one more component: with
``M`` the largest norm of a shard, a vector x of the shard gets
sqrt(M^2 - |x|^2) and a query gets 0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x.  In
that metric each shard is a vantage-point tree: an inner node halves its
vectors by their distance to a vantage point and keeps the distance bounds of
both halves; a leaf is scanned.  A branch can't hold anything nearer than the
gap between the query's distance to the vantage point and the branch's bounds
(triangle inequality), and is passed over if ``relax`` times that gap exceeds
the distance of the worst result kept.  ``relax`` 1 is exact; more prunes more
and may miss.

Results are ranked by inner products and not by distances, and what is kept
or pruned allows for the rounding of both: the slack grows with the norms (and
with the number of components) times the machine's epsilon, so it holds at
every scale.  Whatever may be among the ``k`` nearest is scored exactly (the
original vectors, summed in component order, in double precision) before ties
go to the smaller id.  Of equal vectors in a shard only the ``k + 1`` smallest
ids enter the tree, which changes no result and keeps copies from piling up.

A task holds one shard, of bounded bytes, and builds its tree once; the
queries stream past it in batches, and each shard keeps ``k`` rows per query,
which are merged by query.  So a vector is shuffled once and a query once per
shard.

Vectors that are null, zero, or hold null or non-finite components take no
part.  Queries meet vectors of their own length only.  Rows that repeat an id
count once (the largest vector in array order).  A null id takes no part; an
empty table gives no rows; further columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assonance.llm.batches import bounded_batches
from assonance.plans.durable import durable

#: Bytes of a shard's vectors (as doubles), and queries searched at a time.
SHARD_BYTES, BLOCK_ROWS = 64 << 20, 1_024
LEAF = 128
EPSILON = float(np.finfo(np.float64).eps)


class Tree:
    """A vantage-point tree over the rows of ``points``; ``one_norm`` says that all are equally long (see ``in_space``)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 5, one_norm: bool = False) -> None:
        self.points, self.leaf = points, leaf
        squares = (points * points).sum(axis=1)
        self.square = float(squares.max(initial=0))
        # Nearness is the inner product, less this for shorter points.
        self.less = None if one_norm else (squares - self.square) / 2
        self.order = np.arange(len(points))
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        if len(points):
            self._build(0, len(points))

    def _build(self, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if end - start <= self.leaf:
            self.nodes[at] = (start, end)
            return at
        rows = self.order[start:end]
        # Of a few candidates, the vantage point from which a sample of the others is spread most.
        tried = rows[self.rng.integers(0, len(rows), 5)]
        sample = self.points[rows[self.rng.integers(0, len(rows), 64)]]
        spread = [np.std(np.linalg.norm(sample - self.points[t], axis=1)) for t in tried]
        vantage = self.points[tried[int(np.argmax(spread))]]
        d = np.linalg.norm(self.points[rows] - vantage, axis=1)
        middle = len(rows) // 2
        split = np.argpartition(d, middle)
        self.order[start:end], d = rows[split], d[split]
        near, far = d[:middle], d[middle:]
        bounds = (near.min(), near.max(), far.min(), far.max())
        left = self._build(start, start + middle)
        right = self._build(start + middle, end)
        self.nodes[at] = (vantage, bounds, left, right)
        return at

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers and inner products of at least the ``k`` nearest of each query, flat by query, and the products computed.

        ``skip``: for each query a row that isn't a result for it, or -1.  Rows that rounding could have put
        behind the ``k``-th are given too, for the caller to score exactly.
        """
        n = len(queries)
        best = np.full((n, k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        work = 0
        own = (queries * queries).sum(axis=1)
        # A sum of products of m components errs by m times epsilon of the norms' product; twice that, for both sides.
        m = queries.shape[1] + 4
        norm, length = np.sqrt(self.square), np.sqrt(own)
        loose = 4 * m * EPSILON * length * norm
        loose_square = 8 * m * EPSILON * (own + self.square)
        loose_gap = 8 * m * EPSILON * (length + 2 * norm)
        stack = [(0, np.arange(n), np.zeros(n))] if self.nodes else []
        while stack:
            at, who, gap = stack.pop()
            worst = np.maximum(own[who] + self.square - 2 * (best[who, 0] - loose[who]) + loose_square[who], 0)
            alive = relax * gap <= np.sqrt(worst) + loose_gap[who]
            who, gap = who[alive], gap[alive]
            if not len(who):
                continue
            node = self.nodes[at]
            if len(node) == 2:
                rows = self.order[node[0] : node[1]]
                work += len(rows) * len(who)
                g = queries[who] @ self.points[rows].T
                if self.less is not None:
                    g -= self.less[rows]
                if skip is not None:
                    g[skip[who, None] == rows[None, :]] = -np.inf
                some = np.nonzero((g >= best[who, :1] - loose[who, None]).any(axis=1))[0]
                who, g = who[some], g[some]
                merged = np.concatenate([best[who], g], axis=1)
                best[who] = np.sort(np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:], axis=1)
                q, j = np.nonzero((g >= best[who, :1] - loose[who, None]) & (g > -np.inf))
                found.append((who[q], rows[j], g[q, j]))
                continue
            vantage, (a, b, c, e), left, right = node
            work += len(who)
            d = np.linalg.norm(queries[who] - vantage, axis=1)
            to_left = np.maximum(gap, np.maximum(a - d, d - b))
            to_right = np.maximum(gap, np.maximum(c - d, d - e))
            # The half that more queries are nearer to is looked at first; each query's bound tightens there.
            first_left = (to_left <= to_right).mean() >= 0.5
            halves = [(left, who, to_left), (right, who, to_right)]
            stack += halves[::-1] if first_left else halves
        if not found:
            return np.zeros(0, int), np.zeros(0, int), work
        q, j, g = (np.concatenate(x) for x in zip(*found, strict=True))
        last = g >= best[q, 0] - loose[q]
        return q[last], j[last], work


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def in_space(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the norm of the longest."""
    squares = (vectors * vectors).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of pairs of rows, summed one component after the other."""
    out = np.zeros(len(q))
    for i in range(q.shape[1] if len(q) else 0):
        out += q[:, i] * x[:, i]
    return out


class Shard:
    """The tree of one shard, and the nearest of its rows to queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.k = k
        if len(ids):
            ids, vectors = _few_copies(ids, vectors, k + 1)
        self.ids, self.vectors = ids, vectors
        # Long vectors would overflow in squares: all are scaled by one power of two, which rounds nothing.
        most = float(np.abs(vectors).max(initial=0))
        self.scale = 2.0 ** -int(np.frexp(most)[1]) if most else 1.0
        self.tree = Tree(in_space(vectors * self.scale), one_norm=True)
        self.by_id = np.argsort(ids)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores of the ``k`` nearest rows of each query, but for the query's own."""
        at = np.searchsorted(self.ids, query_ids, sorter=self.by_id)
        at = self.by_id[np.minimum(at, len(self.ids) - 1)]
        skip = np.where(self.ids[at] == query_ids, at, -1)
        # A query's length changes none of its ranks; at that of the longest vector, most can be pruned.
        unit = queries / np.abs(queries).max(axis=1, initial=0)[:, None]
        unit *= (np.sqrt(self.tree.square) / np.linalg.norm(unit, axis=1))[:, None]
        q, j, _ = self.tree.search(np.concatenate([unit, np.zeros((len(queries), 1))], axis=1), self.k, relax, skip)
        score = inner_products(queries[q], self.vectors[j])
        order = np.lexsort((self.ids[j], -score, q))
        q, j, score = q[order], j[order], score[order]
        first = np.searchsorted(q, q, "left")
        top = np.arange(len(q)) - first < self.k
        return query_ids[q[top]], self.ids[j[top]], score[top]


def _few_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of one vector those with the ``most`` smallest ids."""
    order = np.lexsort((ids, *vectors.T))
    new = np.ones(len(order), bool)
    new[1:] = (vectors[order[1:]] != vectors[order[:-1]]).any(axis=1)
    starts = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    keep = np.sort(order[np.arange(len(order)) - starts < most])
    return ids[keep], vectors[keep]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(vectors: pa.ListArray, length: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _streamed(k: int, relax: float, block_rows: int):
    """Rows sorted by shard and length, a shard's vectors before its queries: what is found in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, shard = None, [], [], None
        for batch in batches:
            shards, lengths, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.nonzero((np.diff(shards) != 0) | (np.diff(lengths) != 0) | (np.diff(asks) != 0))[0] + 1
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start == end:
                    continue
                key, part = (shards[start], lengths[start]), batch.slice(start, end - start)
                if key != now:
                    now, ids, parts, shard = key, [], [], None
                some, vectors = part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4), int(key[1]))
                if not asks[start]:
                    ids.append(some)
                    parts.append(vectors)
                    continue
                if shard is None and ids:
                    shard, ids, parts = Shard(np.concatenate(ids), np.concatenate(parts), k), [], []
                for at in range(0, len(some) if shard else 0, block_rows):
                    found = shard.nearest(some[at : at + block_rows], vectors[at : at + block_rows], relax)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=_FOUND)

    return run


def search(
    vectors: DataFrame,
    is_query: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    relax: float = 1.0,
    shard_rows: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows of each row that ``is_query`` names.

    ``shard_rows``: by default as many vectors as ``SHARD_BYTES`` hold.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    rows = durable(rows.groupBy("vec_id").agg(F.max("x").alias("x"), F.max("q").alias("q")))
    n, longest = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    shard_rows = shard_rows or max(1, SHARD_BYTES // (8 * (longest or 1)))
    shards = max(1, -(-n // shard_rows))
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    row = lambda shard, asks: [shard.alias("shard"), F.size("x").alias("length"), F.lit(asks).alias("asks"), "vec_id", "x"]
    both = rows.select(*row(own, False)).union(rows.where("q").select(*row(every, True)))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "length", "asks")
    found = dealt.mapInArrow(_streamed(k, relax, block_rows), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
