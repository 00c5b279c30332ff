"""Sound tables and similarity matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assonance.functions.sounds import SELECTED, TableSounds

#: Entries of a reading that name its source.
SOURCE_ENTRIES = 2
#: Entries that a table in the plan may have.
MOST_ENTRIES = 200_000


def read_sound_table(spark: SparkSession, path: str) -> DataFrame:
    """``grapheme``, ``segments`` of a JSON object grapheme -> readings: the first reading without its sources."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("grapheme", "readings"))
    first = F.element_at("readings", 1)
    return each.select("grapheme", F.slice(first, F.lit(1), F.greatest(F.size(first) - SOURCE_ENTRIES, F.lit(0))).alias("segments"))


def table_sounds(table: DataFrame, select: tuple[int, ...] | None = SELECTED) -> TableSounds:
    """A sound table as columns; its size is checked before it goes into plans."""
    if table.count() > MOST_ENTRIES:
        raise ValueError(f"a sound table of more than {MOST_ENTRIES} entries")
    return TableSounds({r["grapheme"]: list(r["segments"]) for r in table.collect()}, select)


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """``a``, ``b``, ``score`` of a tab-separated square matrix with labels on both sides."""
    wide = spark.read.csv(path, sep="\t", header=True)
    label, *others = wide.columns
    long = wide.unpivot([label], others, "b", "score")
    return long.select(F.col(f"`{label}`").alias("a"), "b", F.col("score").cast("double").alias("score"))


def scorer(similarities: DataFrame) -> dict[tuple[str, str], float]:
    """For aligners: pairs of symbols to scores.  Symbols are few; the size is checked."""
    if similarities.count() > MOST_ENTRIES:
        raise ValueError("a similarity matrix too large for an aligner")
    return {(r["a"], r["b"]): r["score"] for r in similarities.collect()}
