"""Exact dedup with a heavy-hitter split.

A text is known by the SHA-256 of its normal form (each run of blanks is one
space); digests and ids are stored once, and texts aren't read again.
Misra-Gries counters, one set per task and combined in two rounds (Spark's
frequent-items sketch, whose counters are all lowered together when they are
full), name the digests that may be frequent.  Their exact counts are taken,
and those that hold are the winners: few by construction, so they are
broadcast, and their rows get their result where they lie.  All other digests
are shuffled, and none of them fills more than a part of a task.  Results
don't depend on the counters, only where rows are worked on does.

A null text counts as empty, and empty texts are equal like others; a very
long text is digested whole.  Of equal texts the least id stays; rows that
repeat the id that stays all stay, rows without id go where some row of the
group has one and all stay where none has.  An empty table gives no rows.
Further columns aren't read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assonance.plans.durable import durable
from assonance.plans.joins import bounded_join

#: Fixed value: what counts as blank between words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Counters of a task, by the number of shuffle partitions within these bounds.
LEAST_COUNTERS, MOST_COUNTERS = 4_096, 131_072
#: Digests of fewer rows are never treated as frequent.
LEAST_HEAVY = 256
#: Sets of counters that one task of the first round combines.
TOGETHER = 64


def normal_form(text: Column) -> Column:
    """The text with one space for each run of blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _counters(partitions: int) -> int:
    """A power of two, some 16 for each shuffle partition."""
    return min(max(1 << (16 * partitions - 1).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)


def frequent(digests: DataFrame, counters: int, least: int) -> DataFrame:
    """``digest``, ``keep_id`` and ``group_size`` of all digests that at least ``least`` rows have, and of no other.

    All of them are found if ``least`` is at least 8 / ``counters`` of the rows.
    """
    item = digests.select(F.xxhash64("digest").alias("item"), F.spark_partition_id().alias("task"))
    each = item.groupBy("task").agg(F.expr(f"approx_top_k_accumulate(item, {counters})").alias("kept"))
    some = each.groupBy(F.floor(F.col("task") / TOGETHER)).agg(F.expr(f"approx_top_k_combine(kept, {counters})").alias("kept"))
    # By a constant, so that an empty table gives no row and not an empty sketch.
    every = some.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(kept, {counters})").alias("kept"))
    named = every.select(F.explode(F.expr(f"approx_top_k_estimate(kept, {counters})")).alias("x")).where(F.col("x.count") >= least)
    # At most ``counters`` numbers, by construction of the sketch.
    held = digests.join(F.broadcast(named.select(F.col("x.item").alias("item"))), F.xxhash64("digest") == F.col("item"), "left_semi")
    exact = held.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return exact.where(F.col("group_size") >= least)


def groups(documents: DataFrame, id: str = "doc_id", text: str = "text", counters: int | None = None, least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """One row per document: ``id``, ``digest`` (of the normal form, binary), ``keep_id``, ``group_size`` and ``kept``."""
    spark = documents.sparkSession
    digest = F.unhex(F.sha2(normal_form(F.col(f"`{text}`")), 256))
    digests = durable(documents.select(F.col(f"`{id}`").alias("id"), digest.alias("digest")))
    counters = counters or _counters(int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = max(least_heavy, -(-8 * digests.count() // counters))
    winners = durable(frequent(digests, counters, least))
    marked = digests.join(F.broadcast(winners), "digest", "left")
    done = marked.where(F.col("group_size").isNotNull())
    same = Window.partitionBy("digest")
    rest = marked.where(F.col("group_size").isNull()).select("digest", "id", F.min("id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"))
    return done.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def keep_one_of_each(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    found = groups(documents, id, text)
    # Texts aren't shuffled for this unless very many ids go; a row without id goes by its digest.
    gone = durable(found.where(~F.col("kept")).select("id", "digest").distinct())
    kept = documents.withColumn("__digest", F.unhex(F.sha2(normal_form(F.col(f"`{text}`")), 256))).withColumn("__id", F.col(f"`{id}`"))
    gone = gone.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("__known"), F.col("digest").alias("__digest"))
    kept = kept.withColumn("__known", F.coalesce(F.col("__id").cast("string"), F.lit("")))
    return bounded_join(kept, gone, ["__known", "__digest"], "left_anti", gone.count()).select(*[F.col(f"`{c}`") for c in documents.columns])
