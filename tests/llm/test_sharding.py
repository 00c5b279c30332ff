import zlib

import pytest
from pyspark.sql import functions as F

from assonance.llm.sharding import shard_by_bytes, text_size


def placed(frame, key="doc_id", **options):
    return shard_by_bytes(frame, key, text_size(F.col("text")), **options).select("row.*", F.col("shard").alias("to"), F.col("slot").alias("at")).collect()


def check(rows, shards):
    sizes = {s: 0 for s in range(shards)}
    for r in rows:
        sizes[r["to"]] += len((r["text"] or "").encode()) + 1
    for s in range(shards):
        assert sorted(r["at"] for r in rows if r["to"] == s) == list(range(sum(r["to"] == s for r in rows)))
    largest = max((len((r["text"] or "").encode()) + 1 for r in rows), default=0)
    total = sum(sizes.values())
    assert all(abs(n - total / shards) <= 2 * largest for n in sizes.values())


def test_odd_rows(docs):
    rows = placed(docs)
    assert len(rows) == 10 and {r["shard"] for r in rows} == {7}
    check(rows, 8)


def test_empty(no_docs):
    assert placed(no_docs) == []


@pytest.mark.parametrize("key", ["doc_id", "name"])
def test_one_key_holds_most_rows(spark, key):
    frame = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "é'x").otherwise(F.col("id").cast("string")).alias("name"),
        F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"),
    )
    rows = placed(frame.repartition(5), key, shards=6, ranges=64)
    assert len(rows) == 4000
    check(rows, 6)
    order = sorted(rows, key=lambda r: (r["to"], r["at"]))
    assert [r[key] for r in order] == sorted(r[key] for r in rows)


def test_crc_is_unsigned(spark):
    for text in ("", "é", "abc"):
        assert spark.range(1).select(F.crc32(F.lit(text))).first()[0] == zlib.crc32(text.encode())
