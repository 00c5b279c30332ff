"""Periodic runs against plain loops, on random sequences and through the registered query."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assonance.llm import runs
from assonance.llm.queries import queries


def plain_runs(w, least=24, periods=3):
    """Every distance, every maximal stretch of equal words that far apart."""
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, periods * q) and not any(w[s : e - r] == w[s + r : e] for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    number = {}
    return [number.setdefault(x, len(number)) for x in words]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9), st.integers(3, 4), st.sampled_from([3, 6, 24]))
def test_random_sequences(seed, periods, least):
    rng = random.Random(seed)
    w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(100))]
    for _ in range(rng.randrange(3)):
        if w:
            a = rng.randrange(len(w))
            p = 1 + rng.randrange((len(w) - a) // 3 + 1)
            for i in range(a, rng.randrange(a, len(w))):
                w[i] = w[a + (i - a) % p] if a + (i - a) % p < len(w) else w[i]
    assert runs.runs_of(numbered(w), least, periods) == plain_runs(w, least, periods)


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 4000])
def test_one_word_and_two(n):
    assert runs.runs_of([0] * n) == ([(0, n, 1)] if n >= 24 else [])
    assert runs.runs_of([i % 2 for i in range(n)]) == ([(0, n, 2)] if n >= 24 else [])


@pytest.mark.parametrize("word", [lambda i: i.bit_count() % 2, lambda i: int((i + 1) * 0.618034) - int(i * 0.618034), lambda i: (i & -i).bit_length()])
def test_words_with_much_in_common(word):
    w = numbered([word(i) for i in range(1, 1500)])
    assert runs.runs_of(w) == plain_runs(w)


def test_hashes_that_lie_change_nothing():
    """What a hash calls equal is compared word by word."""

    class Lying(runs.Extensions):
        def _same(self, i, j, size):
            return True

    rng = random.Random(1)
    w = [rng.randrange(2) for _ in range(300)]
    e = Lying(runs.np.array(w))
    for _ in range(500):
        i, j = sorted(rng.sample(range(300), 2))
        k = 0
        while j + k < 300 and w[i + k] == w[j + k]:
            k += 1
        b = 0
        while i - b > 0 and w[i - b - 1] == w[j - b - 1]:
            b += 1
        assert (e.forward(i, j), e.backward(i, j)) == (k, b)


def test_under_three_periods():
    with pytest.raises(ValueError):
        runs.runs_of([0] * 30, periods=2)


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(numbered(words))
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    rows = [(i, text(rng.randrange(200))) for i in range(150)]
    rows += [(200 + i, "\n".join(["read more here now"] * (6 + i))) for i in range(10)]
    tenth = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:8]
    rows += list(zip(tenth, [None, "", " \t", "one", "a b", text(500), "x\x1fy z q " * 40, "a " * 100], strict=True))
    rows += [(None, "a b " * 30), (7, None), (7, None), (8, ""), (9, "é\x00日本 " * 24), (9, "é\x00日本 " * 24), (10, text(3000) + " k l m" * 400), (11, "z" * 40_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "runs", "n_words", "f", "best", "collapsed")})
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in COLUMNS) for r in queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert any(r[2] is not None for r in got if r[0] in tenth)


def test_whole_columns_and_no_rows(spark, docs, no_docs):
    out = runs.with_runs(docs, "text", least=3)
    assert sorted(out.select("row.*").collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert runs.with_runs(no_docs).count() == 0
    one = runs.with_runs(spark.createDataFrame([("a b a b a b c",)], "text string"), least=6).first()
    assert one["collapsed"] == "a b c" and [tuple(r) for r in one["runs"]] == [(0, 6, 2)] and one["n_words"] == 7
