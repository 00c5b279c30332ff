from assonance.llm import quality


def test_a_repeated_id_is_one_text_of_the_sample(spark, monkeypatch):
    ids = list(range(60))
    docs = spark.createDataFrame([(i, f"text of its own {i}") for i in ids] + [(ids[0], "hot text")] * 500 + [(ids[0], None)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.FactorisationMachine, "fit", classmethod(lambda cls, slots, stats, y: seen.append((len(slots), len(stats), sorted(y)))))
    quality.train(docs, labels)
    quality.train(docs, labels, sample=10)
    known = labels.where(~quality.held_out(labels["doc_id"])).count()
    assert seen[0][:2] == (known, known) and seen[1][:2] == (10, 10)
    assert set(seen[1][2]) == {0.0, 1.0}
