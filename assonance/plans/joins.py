"""Equi-joins whose broadcast side is measured first (none other is broadcast), with a salted way beyond the bound, and a grid for keys that are hot on both sides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.plans.durable import durable

#: What a broadcast side may hold.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key of more rows than this is hot: its rows are dealt over as many tasks as it has times so many, but at most ``SALTS``.
HOT_ROWS, SALTS = 256, 4_096
#: Hot keys that are broadcast; if there are more, they meet their rows in a join of their own.
HOT_KEYS = 20_000
#: Pairs that a task makes of one key of a grid join.
CELL_PAIRS = 500_000


def shuffled_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join that stays a shuffled one.

    Left to Spark, any side that turns out below its bound for broadcasts goes
    through the driver, several at once, whatever the driver can hold.
    """
    return left.join(right.hint("merge"), on, how)


def bounded_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    right_rows: int,
    spread: Column | None = None,
    limit: int = BROADCAST_ROWS,
    salts: int = SALTS,
    right_bytes: int = 0,
    *,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to the dimension ``right``, of which ``right_rows`` (and ``right_bytes``) were measured.

    Up to ``limit`` rows and ``BROADCAST_BYTES`` the right side is broadcast;
    beyond that it is a ``skewed_join`` (with ``counts`` of the left keys, if known).
    """
    if right_rows <= limit and right_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), list(on), how)
    return skewed_join(left, right, on, how, spread, salts=salts, counts=counts)


def skewed_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Column | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """A shuffled join in which no hot key of ``left`` meets in one task.

    Keys of over ``hot_rows`` rows are found by an aggregation (or given as
    ``counts``: the keys and ``n``).  Rows of such a key are dealt over salts
    by ``spread`` (default: a hash of the row), and only the right rows of
    those keys are repeated, once per salt.
    """
    on = list(on)
    counts = left.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where(F.col("n") > hot_rows).select(*on, F.least(F.ceil(F.col("n") / hot_rows), F.lit(salts)).cast("int").alias("__salts"))
    hot = durable(hot)
    n_hot = hot.count()
    if not n_hot:
        return shuffled_join(left, right, on, how)
    told = F.broadcast(hot) if n_hot <= HOT_KEYS else hot
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]) if spread is None else spread
    # Hashed once more: rows of one task must not agree in the salt.
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread, F.lit(41)), F.col("__salts"))).cast("int")
    with_salts = (lambda side: side.join(told, on, "left")) if n_hot <= HOT_KEYS else (lambda side: shuffled_join(side, told, on, "left"))
    salted = with_salts(left).withColumn("__salt", salt).drop("__salts")
    repeated = with_salts(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return shuffled_join(salted, repeated, [*on, "__salt"], how).drop("__salt")


def grid_sides(left: DataFrame, right: DataFrame, on: Sequence[str], left_spread: Column, right_spread: Column, cell_pairs: int = CELL_PAIRS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an inner join ready to be joined on the columns that are returned, no key of which makes much over ``cell_pairs`` pairs.

    The pairs of a hot key are a rectangle, which is cut into rows and columns
    of cells about as wide as high: a left row goes to all cells of its row
    and a right row to all of its column, so that each is repeated by about
    the square root of the number of cells.
    """
    on, most = list(on), math.isqrt(cell_pairs)
    count = lambda side, name: side.groupBy(*on).agg(F.count("*").alias(name))
    both = count(left, "__nl").join(count(right, "__nr"), on)
    hot = both.where(F.col("__nl").cast("double") * F.col("__nr") > cell_pairs)
    # A side of fewer rows than a cell is wide isn't cut, and the other one so much more.
    cut = lambda n, other: F.greatest(F.ceil(F.col(n) * F.least(F.col(other), F.lit(most)) / cell_pairs), F.lit(1)).cast("int")
    hot = durable(hot.select(*on, cut("__nl", "__nr").alias("__rows"), cut("__nr", "__nl").alias("__columns")))
    n_hot = hot.count()
    if not n_hot:
        return left, right, on
    told = F.broadcast(hot) if n_hot <= HOT_KEYS else hot

    def dealt(side: DataFrame, spread: Column, own: str, other: str, at: str, all_: str) -> DataFrame:
        number = F.when(F.col(own).isNull(), 0).otherwise(F.pmod(F.xxhash64(spread, F.lit(43)), F.col(own))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return side.join(told, on, "left").withColumn(at, number).withColumn(all_, every).drop("__rows", "__columns")

    return (
        dealt(left, left_spread, "__rows", "__columns", "__row", "__column"),
        dealt(right, right_spread, "__columns", "__rows", "__column", "__row"),
        [*on, "__row", "__column"],
    )


def grid_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_spread: Column, right_spread: Column, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """An inner join whose keys may be hot on both sides."""
    a, b, keys = grid_sides(left, right, on, left_spread, right_spread, cell_pairs)
    return a.join(b, keys).drop("__row", "__column")
