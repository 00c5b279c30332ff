"""Components, ordinals and size-checked joins."""

import random

import pytest
from pyspark.sql import functions as F

from assonance.plans.components import connected_components
from assonance.operators.index import values_to_meet
from assonance.plans import joins, sieve
from assonance.plans.joins import bounded_join, grid_join, grid_sides, skewed_join
from assonance.plans.ordinal import with_ordinal


def by_hand(edges):
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a in low and b in low and a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return low


@pytest.mark.parametrize("local", [500_000, 40])
def test_components(spark, local):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (2000, None)]
    edges += [(3000, 3000 + i) for i in range(1, 80)]
    got = connected_components(spark.createDataFrame(edges, "x long, y long").repartition(6), "x", "y", local=local)
    assert {r["node"]: r["component"] for r in got.collect()} == by_hand(edges)


def test_components_of_names_and_of_nothing(spark):
    frame = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "x string, y string")
    got = connected_components(frame, "x", "y")
    assert {r["node"]: r["component"] for r in got.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(frame.where("false"), "x", "y").count() == 0
    assert connected_components(frame.where("false"), "x", "y", local=1).count() == 0


def test_ordinals(spark):
    frame = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    got = with_ordinal(frame.repartition(5), "at", F.desc("k")).collect()
    assert sorted((r["at"], r["k"]) for r in got) == [(499 - k, k) for k in range(499, -1, -1)]
    assert with_ordinal(frame.where("false"), "at", F.asc("k")).count() == 0


@pytest.mark.parametrize("limit", [10, 1])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_bounded_join(spark, limit, how):
    left = spark.createDataFrame([(i, "hot" if i % 4 else f"k{i}") for i in range(200)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k4", 2)], "k string, v int")
    got = bounded_join(left, right, ["k"], how, 2, limit=limit, salts=8)
    want = left.join(right, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 4 else f"k{i}") for i in range(400)] + [(-1, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 3), ("k4", 2), (None, 9)], "k string, v int")
    got, want = skewed_join(left, right, ["k"], how, hot_rows=20), left.join(right, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_dealt_over_tasks(spark):
    left, right = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") * 0).alias("k")), spark.createDataFrame([(0, "x")], "k long, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = skewed_join(left, right.hint("merge"), ["k"], hot_rows=100).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(parts) == 4000 and max(parts) < 2500


def test_components_of_a_hub(spark):
    edges = [(1, i) for i in range(2, 400)] + [(i, 10_000 - i) for i in range(2, 400)]
    got = connected_components(spark.createDataFrame(edges, "x long, y long").repartition(6), "x", "y", local=40, hot_rows=20)
    assert {r["component"] for r in got.collect()} == {1} and got.count() == 797


def test_running_sums(spark):
    frame = spark.range(300).select((F.col("id") * 7919 % 300).alias("k"))
    got = with_ordinal(frame.repartition(5), "at", F.asc("k"), weight=F.col("k")).collect()
    assert sorted((r["k"], r["at"]) for r in got) == [(k, k * (k - 1) // 2) for k in range(300)]


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from assonance.plans import durable

    gone = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: gone))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_batches_are_bounded(spark):
    """Settings are lowered from their defaults, and never raised."""
    from assonance.plans.batches import at_most, bounded_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    bounded_batches(spark, 5 << 20)
    assert spark.conf.get(name).removesuffix("b") == str(5 << 20)
    bounded_batches(spark, 9 << 20)
    assert spark.conf.get(name).removesuffix("b") == str(5 << 20)
    at_most(spark, name, 1 << 20)
    assert spark.conf.get(name).removesuffix("b") == str(1 << 20)
    spark.conf.unset(name)


def test_small_tables_are_dealt_out(spark, tmp_path):
    from assonance.plans import spread as S

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    parts = S.spread(table).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(parts) == 1000 and min(parts) > 100
    assert S.spread(table.repartition(1).where("id < 0")).count() == 0


@pytest.mark.parametrize("broadcast_keys", [20_000, 0])
@pytest.mark.parametrize("cell_pairs", [1, 50, 10_000])
def test_grid_join(spark, monkeypatch, cell_pairs, broadcast_keys):
    """Keys hot on one side, on both, on none, and repeated rows; hot keys broadcast or not."""
    monkeypatch.setattr(joins, "HOT_KEYS", broadcast_keys)
    left = spark.createDataFrame([(i, "hot" if i % 2 else "wide" if i % 3 else f"k{i % 7}") for i in range(120)] + [(1, "hot"), (500, None)], "i int, k string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}") for i in range(90)] + [(7, "wide"), (501, None)], "j int, k string")
    got = grid_join(left, right, ["k"], F.xxhash64("i"), F.xxhash64("j"), cell_pairs)
    want = left.join(right, "k")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_that_a_grid_repeats(spark):
    """A key of 100,000 rows on both sides: 2,500 cells, and each row goes to 50 of them, where dealing one side alone would send a row of the other to all."""
    n = 100_000
    left, right = spark.range(n).select(F.col("id").alias("i"), F.lit("k").alias("k")), spark.range(n).select(F.col("id").alias("j"), F.lit("k").alias("k"))
    a, b, keys = grid_sides(left, right, ["k"], F.xxhash64("i"), F.xxhash64("j"), 4_000_000)
    assert a.count() == b.count() == 50 * n
    largest = a.groupBy(*keys).count().agg(F.max("count")).first()[0]
    assert keys == ["k", "__row", "__column"] and largest < 1.2 * 2000
    one = spark.range(300).select(F.col("id").alias("j"), F.lit("k").alias("k"))
    a, b, _ = grid_sides(left, one, ["k"], F.xxhash64("i"), F.xxhash64("j"), 4_000_000)
    assert a.count() == n and b.count() == 300 * 8


@pytest.mark.parametrize("how", ["inner", "left"])
def test_more_hot_keys_than_are_broadcast(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    left = spark.createDataFrame([(i, f"k{i % 9}") for i in range(300)], "i int, k string")
    right = spark.createDataFrame([(f"k{j}", j) for j in range(6)], "k string, v int")
    got, want = skewed_join(left, right, ["k"], how, hot_rows=5), left.join(right, "k", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_only_measured_sides_are_broadcast(spark):
    small = lambda k, v: spark.range(4).select(F.col("id").alias(k), F.col("id").alias(v))
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "BroadcastHashJoin" not in plan(skewed_join(small("k", "a"), small("k", "b"), ["k"], how))
        assert "BroadcastHashJoin" not in plan(bounded_join(small("k", "a"), small("k", "b"), ["k"], how, 2, limit=1))
    # Hot keys are counted and told to both sides, and nothing else is.
    hot = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    assert plan(skewed_join(hot, small("k", "b"), ["k"], hot_rows=8)).count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("words", [1 << 22, 1 << 10])
def test_a_sieve_loses_no_key(spark, monkeypatch, words):
    monkeypatch.setattr(sieve, "WORDS", words)
    rows = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    known = spark.range(0, 20_000, 7).select(F.xxhash64(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("h"))
    out = sieve.sifted(rows, F.xxhash64("k"), known, known.count())
    got = {int(r["k"][1:]) for r in out.collect()}
    assert got >= set(range(0, 20_000, 7)) and len(got) < 4_000
    assert out.columns == ["k"] and sieve.sifted(rows, F.xxhash64("k"), known.where("false"), 0).count() == 0


def test_values_that_may_meet_are_not_shuffled(spark):
    rows = [(f"k{i % 500}", f"t{i % 500 if i % 5 else i}", i, i) for i in range(2_000)]
    index = spark.createDataFrame(rows, "key string, text string, doc_ord long, start int")
    out = values_to_meet(index, forms=True)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    kept = {r["key"] for r in out.collect()}
    assert kept >= {f"k{i}" for i in range(0, 500, 5)} and len(kept) < 150
