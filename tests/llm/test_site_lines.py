import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "read more of this on our pages"
PASSAGE = " ".join(f"passage{k}" for k in range(60))
SITES = {"hot": (1000, 15), "large": (500, 8), **{f"small{k}": (30, 5) for k in range(50)}}


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (s, t) in enumerate(rows)], COLUMNS)
    return [r["text"] for r in corpus_pipeline.drop_site_lines(spark, docs, "").orderBy("doc_id").collect()]


def own(k):
    return " ".join(f"own{k} word{j * k % 997}" for j in range(100))


def test_repeated_lines_and_passages_in_hot_large_and_small_sources(spark):
    rows = []
    for site, (n, planted) in SITES.items():
        for k in range(n):
            extra = [LINE] * (k < planted) + [PASSAGE] * (planted <= k < 2 * planted) + ["on four pages only"] * (n - 5 < k < n) + ["Yes."] * (k % 15 == 0)
            rows.append((site, "\n".join([own(len(rows)), *extra])))
    got = stage(spark, rows)
    assert not [t for t in got if LINE in t or PASSAGE in t]
    assert sum("on four pages only" in t for t in got) == 4 * len(SITES)
    assert sum("Yes." in t for t in got) == sum("Yes." in t for _, t in rows)
    assert all(t.startswith(own(i)) for i, t in enumerate(got))


def test_pages_that_are_mostly_boilerplate_lose_it_and_copies_stay(spark):
    menu = ["home and news and contact of the whole site", "all rights are reserved by the owners"]
    rows = [("s", "\n".join([menu[0], f"own {i}", menu[1]])) for i in range(100)] + [("s", "\n".join(menu))]
    copy = "\n".join(["the text of a page", "that is there many times"])
    rows += [("s", copy)] * 50 + [("s", f"{copy}\n{menu[0]}")] * 20 + [("s", None)] * 3
    got = stage(spark, rows)
    assert got[:101] == [*(f"own {i}" for i in range(100)), ""]
    assert set(got[101:171]) == {copy} and got[171:] == [None] * 3
