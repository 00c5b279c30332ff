import numpy as np
import pytest
from pyspark.sql import functions as F

from assonance.llm.neighbours import Shard, Tree, inner_products, search


def by_hand(rows, k):
    known = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, x in known.items():
        if q % 20:
            continue
        near = sorted((-float(inner_products(x[None], y[None])[0]), i) for i, y in known.items() if i != q and len(y) == len(x))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 90])
def test_exact_search(spark, shard_rows):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(45)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None, 1.0]), (1004, []), (1005, [float("inf")] * 8), (1020, [1.0, 2.0]), (1021, [2.0, 1.0]), (None, [1.0] * 8), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "shard": F.lit(2), "q": F.lit(3)})
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search(frame, F.col("vec_id") % 20 == 0, k=20, shard_rows=shard_rows, block_rows=13).collect()}
    assert got == by_hand(rows, 20)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(none, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert search(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_and_recall():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(60, 4))[rng.integers(0, 60, 6000)] * 4 + rng.normal(size=(6000, 4)) * 0.1)
    tree, queries = Tree(points), points[::20]
    truth = np.argsort(((queries[:, None] - points[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    work = {}
    for relax, least in ((1.0, 1.0), (3.0, 0.9)):
        q, j, work[relax] = tree.search(queries, 10, relax)
        hits = np.mean([len(set(j[q == i]) & set(truth[i])) / 10 for i in range(len(queries))])
        assert hits >= least
    assert work[3.0] <= work[1.0] < 0.3 * len(points) * len(queries)


@pytest.mark.parametrize("scale", [1e-100, 1e-3, 1.0, 1e4, 1e7, 1e150])
def test_copies_of_a_longest_vector(scale):
    """Ties go to the smallest ids however long the vectors are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    copies = rng.choice(3000, 600, replace=False)
    x[copies] = x[copies[0]]
    x *= scale
    ids = rng.permutation(3000)
    shard, asked = Shard(ids, x, 20), ids % 20 == 0
    q, found, score = shard.nearest(ids[asked], x[asked], 1.0)
    for i in ids[asked]:
        row = x[ids == i]
        s = inner_products(np.repeat(row, len(x), 0), x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
        assert found[q == i].tolist() == ids[order].tolist() and score[q == i].tolist() == s[order].tolist()


def test_one_very_long_vector():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[77] *= 1e8
    ids = np.arange(3000)
    q, found, _ = Shard(ids, x, 10).nearest(ids[::20], x[::20], 1.0)
    for i in ids[::20]:
        s = inner_products(np.repeat(x[i : i + 1], 3000, 0), x)
        assert found[q == i].tolist() == [j for j in np.lexsort((ids, -s)) if j != i][:10]


def test_a_vector_is_shuffled_once(spark):
    """However many blocks the queries make, rows are sent once and queries once per shard."""
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    plan = search(frame, F.col("vec_id") % 20 == 0, k=3, shard_rows=50, block_rows=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
