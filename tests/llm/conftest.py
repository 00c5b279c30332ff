import pytest

VOCABULARY = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def vocabulary():
    return VOCABULARY.path


#: Nulls, empties, ties, repeated rows, a long text; and columns whose names operators might use themselves.
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta", "a", 1), (2, "alpha beta gamma delta", "a", 1), (3, None, "b", 2), (4, "", None, 2), (5, LONG, "a", None),
    (6, "Ein Satz.\nNoch ein Satz.\n\nEnde", "b", 3), (6, "Ein Satz.\nNoch ein Satz.\n\nEnde", "b", 3), (None, "ohne Nummer", "c", 4), (8, "é x\x00y 日本", "c", 5), (9, "one", "c", 5),
]
SCHEMA = "doc_id long, text string, source string, row long"


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.withColumns({c: F.lit(7) for c in ("id", "shard", "bytes", "key", "n", "host", "n_tokens", "spans")}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
