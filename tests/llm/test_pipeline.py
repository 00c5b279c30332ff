import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of known fates, and what the stages read beside them."""
    top = tmp_path_factory.mktemp("sf")
    good = lambda i, n=60: " ".join(f"leaf{(i * 7919 + k * k * 31) % 5000}" for k in range(n)) + "."
    passage = " ".join(f"bench{k}" for k in range(20))
    docs = [(i, f"shared line of the site\n{good(i)}") for i in range(60)]
    docs += [(100 + i, " ".join(f"WORD{i % 7}!!" for _ in range(30))) for i in range(40)]
    docs += [(200, good(3, 200)), (201, good(3, 200)), (202, good(3, 200) + " more"), (210, passage + " " + good(9, 40)), (220, None), (221, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i < 100), 0) for i in [*range(60), *range(100, 140)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_take_effect(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not [i for i in seen["quality"] if 100 <= i < 140] and set(range(60)) <= set(seen["quality"])
    assert all(r["text"] is None or "shared line" not in r["text"] for r in seen["line_dedup"].values())
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["line_dedup"].values())
    assert 200 in seen["near_dup"] and not {201, 202} & set(seen["near_dup"]) and set(range(60)) <= set(seen["near_dup"])
    assert 210 in seen["near_dup"] and 210 not in seen["decontaminate"] and set(range(60)) <= set(seen["decontaminate"])
    assert all(r["n_pieces"] == len(r["ids"] or ()) for r in seen["sentencepiece"].values())


def test_run(spark, folder):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} >= {*range(60), 200}


def test_registered(spark):
    import __spark_entry__ as entry

    made = entry.queries()
    assert "pipeline" in made and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in made}
    assert set(entry.oracle_sql()) <= set(made)
