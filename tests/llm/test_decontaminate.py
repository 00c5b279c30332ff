import random
import re

import pytest
from pyspark.sql import functions as F

from assonance.llm.decontaminate import contaminated, cut_spans, drop_contaminated, find_hits, n_hit


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(docs, items, window):
    out = {}
    for i, text in docs:
        words, hit, named = cut(text), set(), set()
        for item, passage in items:
            w = cut(passage)
            n = min(len(w), window)
            for s in range(len(w) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[s : s + n]:
                        hit |= set(range(at, at + n))
                        if item is not None:
                            named.add(str(item))
        out[i] = (len(words), len(hit), sorted(named))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 6, 9])))) for i in range(6)] + [(90, None), (91, "..."), (None, "w1 w2 w3 w4 w5 w6"), (2, "É x é x é")]
    docs = [(i, ", ".join(rng.choices([*pool, "W3", "é"], k=rng.randint(0, 60)))) for i in range(60)] + [(100, None), (101, "?!"), (102, "é x É x é X é x é")]
    return docs, items


@pytest.mark.parametrize(("window", "limit"), [(5, 400_000), (4, 400_000), (5, 0)])
def test_against_brute_force(spark, case, window, limit):
    docs, items = case
    found = find_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=window, set_limit=limit)
    got = {r[0]: (r[1], r[2], r[3]) for r in found.select("row.doc_id", "n_words", n_hit(F.col("spans")), "items").collect()}
    assert got == by_hand(docs, items, window)


def test_documents_and_spans_go(spark):
    docs = spark.createDataFrame([(1, "aa bb, cc Dd! ee ff", 1), (2, None, 2), (3, "zz AA bb CC dd ee yy xx", 3), (4, "x! y", 4)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(7, "bb cc dd ee")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench, window=3).collect()) == [2, 4]
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in cut_spans(docs, bench, window=3).collect()} == {1: ("aa  ff", 1), 2: (None, 2), 3: ("zz AA  yy xx", 3), 4: ("x! y", 4)}


def test_odd_rows(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, "Satz noch ein satz ende"), (1, "Satz noch ein satz ende")], "item_id long, text string")
    found = find_hits(docs, bench, window=4).select("row.doc_id", "row.n", "n_words", "spans", contaminated(F.col("spans"), F.col("n_words")).alias("c"))
    rows = found.collect()
    assert len(rows) == 10 and sum(r["c"] for r in rows) == 2
    assert find_hits(no_docs, bench).count() == 0
    assert find_hits(docs, bench.where("false")).where(F.size("spans") > 0).count() == 0
    assert drop_contaminated(docs, bench.where("false")).count() == 10


def test_long_text_with_a_passage_at_its_end(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, " ".join(f"n{i}" for i in range(40_000)) + " " + passage)], "doc_id long, text string")
    row = find_hits(docs, spark.createDataFrame([(5, passage)], "item_id long, text string")).first()
    assert [tuple(s) for s in row["spans"]] == [(40_000, 40_013)] and row["items"] == ["5"]


@pytest.mark.parametrize("limits", [{"set_limit": 0}, {"set_limit": 0, "bloom_limit": 0}])
def test_larger_benchmarks_give_the_same(spark, case, limits):
    """A Bloom filter in the plan, and blocks that meet the grams in a join."""
    docs, items = case
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = find_hits(*frames, window=5, **limits)
    assert {r[0]: (r[1], r[2], r[3]) for r in found.select("row.doc_id", "n_words", n_hit(F.col("spans")), "items").collect()} == by_hand(docs, items, 5)
    for act in (drop_contaminated, cut_spans):
        assert sorted(map(tuple, act(*frames, window=5, **limits).collect())) == sorted(map(tuple, act(*frames, window=5).collect()))


def test_half_a_million_windows(spark):
    """The two-step probe holds at a benchmark of half a million windows."""
    bench = spark.range(1000).selectExpr("id as item_id", "array_join(transform(sequence(0, 511), i -> concat('b', hex(xxhash64(id, i)))), ' ') as text")
    passage = bench.where("item_id = 77").first()["text"].split(" ")
    docs = [(1, "x " * 50 + " ".join(passage[200:213]) + " y" * 60), (2, "z " * 300), (3, " ".join(passage[:12]))]
    found = find_hits(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert "bloom" not in found.columns
    assert {r[0]: (r[1], r[2]) for r in found.select("row.doc_id", n_hit(F.col("spans")), "items").collect()} == {1: (13, ["77"]), 2: (0, []), 3: (0, [])}


def test_cutting_long_texts(spark):
    """As a plain loop over words and gaps cuts them."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(rng.choice([f"N{i},", f"n{i}", passage, passage.upper(), " ".join(passage.split()[3:9])]) for i in range(rng.randint(0, 40))) for _ in range(40)]
    texts.append(" ".join(f"n{i}" for i in range(20_000)) + " " + passage + "!")
    got = {r[0]: r[1] for r in cut_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    grams = {tuple(passage.split()[i : i + 13]) for i in range(18)}
    for i, text in enumerate(texts):
        words, gaps = re.findall(r"[A-Za-z0-9]+", text), re.split(r"[A-Za-z0-9]+", text)
        low = [w.lower() for w in words]
        hit = {j for s in range(len(low) - 12) if tuple(low[s : s + 13]) in grams for j in range(s, s + 13)}
        out = "".join(("" if j in hit and j - 1 in hit else gaps[j]) + ("" if j in hit else w) for j, w in enumerate(words)) + gaps[-1]
        assert got[i] == out
