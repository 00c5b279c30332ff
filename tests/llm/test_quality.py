import zlib

import numpy as np
from pyspark.sql import functions as F

from assonance.llm import quality


def junk(i):
    return " ".join(f"WORD{i % 7}!!" for _ in range(30))


def prose(i):
    return " ".join(f"leaf{(i * 31 + k * k) % 400} and" for k in range(25)) + "."


def test_held_out_accuracy_and_rule(spark):
    rows = [(i, junk(i) if i % 3 == 0 else prose(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(7, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("out"), quality.score(F.col("text"), model).alias("s")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["out"]]
    assert np.mean([(r["s"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in out]) == 1.0


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, prose(i) if i % 2 else junk(i)) for i in range(80)], "doc_id long, text string")
    true = [(i, i % 2) for i in range(80)]
    lied = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in true]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (true, lied))
    assert np.array_equal(a.w, b.w) and np.array_equal(a.v, b.v) and a.w0 == b.w0


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(np.zeros(1), np.ones(1), np.zeros((1, 1)), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=(4, 6))
    slow = [m.w0 + row @ m.w + sum(m.v[i] @ m.v[j] * row[i] * row[j] for i in range(6) for j in range(i + 1, 6)) for row in x]
    assert np.allclose(m.raw(x), slow)


def test_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (8, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = [r[0] for r in docs.select(quality.score(F.col("text"), model)).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    none = quality.train(no_docs, labels)
    assert {r[0] for r in docs.select(quality.score(F.col("text"), none)).collect()} == {0.5}
    assert no_docs.select(quality.score(F.col("text"), model)).count() == 0
