"""Connected components: local contraction, then alternating star contractions.

First each task contracts up to ``LOCAL_EDGES`` edges to stars by union-find,
which leaves at most one edge per node and task; of small graphs one task
then has the result.  Otherwise the stars of all tasks are contracted further:
every step is an aggregation to a minimum and an equi-join.  The neighbours of
a node are counted by that aggregation, and the join deals those of a hub over
many tasks.  The driver sees two numbers per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assonance.plans.durable import durable
from assonance.plans.joins import HOT_ROWS, skewed_join

#: Edges that one task contracts; it bounds the task's memory.
LOCAL_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch], most: int = 4 * LOCAL_EDGES) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        found = [(x, find(x)) for x in list(parent)]
        found = [s for s in found if s[0] != s[1]]
        parent.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found, strict=True)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        # However many edges a task is given, it holds so many nodes: what is given out is a forest of its part.
        if len(parent) > most:
            yield from stars(kind)
    if parent:
        yield from stars(kind)


def _contracted(edges: DataFrame, count: int, local: int) -> DataFrame:
    """A forest of stars for each ``local`` edges or so."""
    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(max(1, -(-count // local))).mapInArrow(_forest, f"u {kind}, v {kind}")


def _signature(edges: DataFrame) -> tuple:
    # A sum of hashes that can't overflow: 32 bits of each, as a decimal.
    part = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32)).cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(part)).first())


def _to_low(edges: DataFrame, least: DataFrame, hot_rows: int) -> DataFrame:
    """``edges`` with ``low`` of their ``u``; ``least`` has also how many neighbours each ``u`` has (``n``)."""
    return skewed_join(edges, least.select("u", "low"), ["u"], hot_rows=hot_rows, spread=F.xxhash64("v"), counts=least.select("u", "n"))


def _large_star(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = durable(both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n"))
    return _to_low(both.where(F.col("v") > F.col("u")), low, hot_rows).select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    low = durable(down.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")))
    moved = _to_low(down, low, hot_rows).where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60, local: int = LOCAL_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node`` and ``component`` (the least node that can be reached) of every node that has an edge to another.

    Nodes may be of any ordered type.  Edges with a null end and loops count
    for nothing; an empty edge table gives no rows.
    """
    given = edges.where(edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b]))
    given = durable(given.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    count = given.count()
    now = durable(_contracted(given, count, local))
    if count > local:
        before = _signature(now)
        for _ in range(rounds):
            now = durable(_small_star(durable(_large_star(now, hot_rows)), hot_rows))
            after = _signature(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
