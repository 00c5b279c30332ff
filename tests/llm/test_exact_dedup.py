"""Exact dedup against plain dictionaries, with and without frequent digests."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assonance.llm import exact_dedup
from assonance.llm.queries import queries


def expected(rows):
    by = defaultdict(list)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    for i, t in rows:
        by[digest(t)].append(i)
    keep = {k: min((i for i in v if i is not None), default=None) for k, v in by.items()}
    return sorted(((i, keep[digest(t)], len(by[digest(t)]), i == keep[digest(t)], digest(t)) for i, t in rows), key=repr)


def made(n=4000):
    rng = random.Random(3)
    rows = [(i, "hot text" if i % 3 == 0 else f"a{rng.choice(' \t\r')}{rng.choice(' \n')}b{rng.randrange(n // 4)}" if i % 5 else None) for i in range(n)]
    rng.shuffle(rows)
    return rows + [(None, "hot text"), (None, "nobody"), (None, "nobody"), (2, "a \n b"), (2, "a b"), (9000, ""), (9001, " "), (9002, "\t\x0b"), (9003, " "), (9004, "\x1f"), (9005, "é " * 50_000), (9006, "é\n" * 50_000)]


@pytest.mark.parametrize("heavy, counters", [(256, None), (2, 4096), (10**9, None)])
def test_groups(spark, heavy, counters):
    """The same rows whatever counts as frequent: much, nearly all, or nothing."""
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = exact_dedup.groups(frame, counters=counters, least_heavy=heavy)
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in out.collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_frequent_are_all_found_and_exact(spark):
    rng = random.Random(1)
    ids = [0] * 5000 + [1] * 2000 + [2] * 701 + [3] * 699 + list(range(10, 30_000))
    rng.shuffle(ids)
    frame = spark.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "id long, t string").select("id", F.encode("t", "utf-8").alias("digest")).repartition(9)
    got = exact_dedup.frequent(frame, 1024, 700).collect()
    assert {(bytes(r["digest"]).decode(), r["group_size"]) for r in got} == {("0", 5000), ("1", 2000), ("2", 701)}
    assert {r["keep_id"] for r in got} == {ids.index(x) for x in (0, 1, 2)}


def test_query_and_no_python(spark, tmp_path):
    rows = made(600)
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "digest", "keep_id", "item", "kept")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["op13_exact_dedup"](spark, str(tmp_path))
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in out.collect()), key=repr) == expected(rows)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_kept_documents(spark, docs, no_docs):
    """Rows that repeat the id that stays all stay, with all columns."""
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 6, 8, 9]
    assert exact_dedup.keep_one_of_each(no_docs).count() == exact_dedup.groups(no_docs).count() == 0
    nobody = spark.createDataFrame([(None, "x"), (None, "x "), (None, "x"), (1, "y"), (None, "y")], "doc_id long, text string")
    assert sorted(r["text"] for r in exact_dedup.keep_one_of_each(nobody).collect()) == ["x", "x", "x ", "y"]
