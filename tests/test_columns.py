"""Normalisation, tokens, sounds and indexes as columns."""

import pytest
from pyspark.sql import functions as F

from assonance.functions import text as X
from assonance.functions.sounds import LATIN, UNKNOWN, TableSounds, are_graphic_variants, register
from assonance.operators import index as I
from assonance.operators.documents import all_phonemes, make_documents, transcription
from assonance.sources.corpus import TableLoader

# Passages, places and results of known cases, which must match.
TOY = TableSounds({"1": ("w", "ʌn"), "one": ("w", "ʌn"), **dict.fromkeys(("2", "two", "to", "too"), ("t", "uː")), "3": ("θ", "riː"), "three": ("θ", "riː")}, select=None)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalise(spark):
    assert value(spark, X.normalise(F.lit("a\t\n b□○　\xa0 c\r"))) == "a b〼〇c"


@pytest.mark.parametrize(("token", "alpha", "number", "alnum"), [("a", 1, 0, 1), ("〼", 1, 0, 1), ("字", 1, 0, 1), ("7", 0, 1, 1), ("〇", 0, 1, 1), ("。", 0, 0, 0), ("\U00031350", 1, 0, 1), ("a b", 0, 0, 0)])
def test_predicates(spark, token, alpha, number, alnum):
    t = F.lit(token)
    got = tuple(value(spark, f(t)) for f in (X.is_alpha, X.is_number, X.is_alnum))
    assert got == (bool(alpha), bool(number), bool(alnum)) == (token.isalpha() or token == "\U00031350", bool(number), bool(alnum))


@pytest.mark.parametrize(("text", "want"), [("", []), ("ab", ["a|", "b|"]), ("a b", ["a| ", "b|"]), ("a   b", ["a| ", "  |", "b|"]), ("𠀀x", ["𠀀|", "x|"])])
def test_char_tokens(spark, text, want):
    got = value(spark, X.char_tokens(F.lit(text)))
    assert [f"{t['text']}|{t['after']}" for t in got] == want


def test_span_text(spark):
    t = X.char_tokens(F.lit("a b c"))
    assert value(spark, X.span_text(t, F.lit(0), F.lit(2))) == "a b"
    assert value(spark, X.span_text(t, F.lit(1), F.lit(1))) == ""


def test_token_phonemes(spark):
    got = {w: value(spark, TOY.token_phonemes(F.lit(w))) for w in ("one", "go", "!")}
    assert got == {"one": ["w", "ʌn"], "go": [UNKNOWN], "!": None}
    assert value(spark, TOY.is_unknown(F.lit("!"))) and not value(spark, TOY.is_unknown(F.lit("two")))
    assert value(spark, TOY.syllable(F.lit("two"))) == "tuː" and value(spark, TOY.syllable(F.lit("go"))) == ""
    assert TOY.empty_size() == 2


def test_selected_segments(spark):
    table = TableSounds({"字": ("0", "1", "2", "dz", "4", "5", "i", "s")})
    assert value(spark, table.token_phonemes(F.lit("字"))) == ["dz", "i", "s"]


@pytest.mark.parametrize(
    ("tokens", "want"),
    [(("two", "too"), 1), (("two", "too", "2", "to"), 1), (("too", "too"), 0), (("too", "two", "one"), 0), (("too", "!"), 0), (("too", "remember"), 0)],
)
def test_graphic_variants(spark, tokens, want):
    assert value(spark, are_graphic_variants(TOY, *map(F.lit, tokens))) is bool(want)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("1", "one two 3 go"), ("2", "won two"), ("3", "")]
    return make_documents(TableLoader("doc_id").of(spark.createDataFrame(rows, "doc_id string, text string")), LATIN, "word")


def test_documents(docs):
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert [rows[i]["doc_ord"] for i in ("1", "2", "3")] == [0, 1, 2]
    assert [t["text"] for t in rows["1"]["tokens"]] == ["one", "two", "go"]
    assert docs.where("doc_id = '1'").select(all_phonemes(F.col("phon"))).first()[0] == ["one", "two", "go"]
    assert docs.where("doc_id = '1'").select(transcription(F.col("syll"))).first()[0] == "*one two go"


def test_ids_are_checked(spark):
    twice = spark.createDataFrame([("1", "a"), ("1", "b")], "doc_id string, text string")
    with pytest.raises(ValueError, match="more than once"):
        make_documents(TableLoader().of(twice), LATIN)


@pytest.mark.parametrize(("n_tokens", "order", "want"), [(7, 1, 7), (7, 2, 6), (7, 3, 5), (0, 3, 0), (1, 3, 1), (2, 5, 1)])
def test_ngram_starts(spark, n_tokens, order, want):
    assert len(value(spark, X.ngram_starts(F.lit(n_tokens), order))) == want


def test_index(spark):
    one = make_documents(TableLoader().of(spark.createDataFrame([("1", "To be or not to be that")], "doc_id string, text string")), LATIN, "word")
    values = I.ngrams(one, 1).where(F.col("tokens")[0]["text"] != "to")
    index = I.build_index(values, F.col("tokens")[0]["text"])
    assert (I.number_of_keys(index), I.number_of_values(index)) == (4, 5)
    assert I.contains(index, "be") and not I.contains(index, "missing")
    assert [r["start"] for r in I.lookup(index, "be").collect()] == [1, 5]
    lists = {r["key"]: r for r in I.postings(index).collect()}
    assert lists["be"]["n"] == 2 and lists["or"]["first"]["start"] == 2
    assert I.keys_where(index, F.col("n") == 1).where("key = 'be'").count() == 0


def test_phonetic_index_leaves_out_unknown_and_marks(spark):
    rows = spark.createDataFrame([("1", "ab。cd 7ef"), ("2", "ßab")], "doc_id string, text string")
    docs = make_documents(TableLoader().of(rows), LATIN, "char")
    got = {(r["doc_id"], r["start"]): r["key"] for r in I.phonetic_index(docs, 2).collect()}
    assert got == {("1", 0): "ab", ("1", 3): "kd", ("1", 6): "ef", ("2", 1): "ab"}


@pytest.mark.parametrize("sounds", [TOY, LATIN, TableSounds({"字": ("0", "1", "2", "dz", "4", "5", "i", None), "子": ("0", "1", "2", "dz", "4", "5", "i", None)})], ids=["toy", "latin", "segments"])
def test_registered_functions(spark, sounds):
    """The functions for SQL give what the columns give."""
    register(spark, sounds, "t_")
    words = spark.createDataFrame([(w,) for w in ("one", "1", "two", "too", "go", "!", "字", "子", "7", "")] + [(None,)], "token string")
    t = F.col("token")
    told = words.select("token", sounds.token_phonemes(t), sounds.syllable(t), sounds.is_unknown(t), sounds.is_voiced(t)).collect()
    got = words.selectExpr("token", "t_phonemes(token)", "t_syllable(token)", "t_is_unknown(token)", "t_is_voiced(token)").collect()
    assert list(map(tuple, got)) == list(map(tuple, told))
    pairs = words.crossJoin(words.toDF("other"))
    both = pairs.select(are_graphic_variants(sounds, t, F.col("other")).alias("a"), F.expr("t_variants(token, other)").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and any(r["a"] for r in both) == (sounds is not LATIN)


def test_characters_are_looked_up_once(spark):
    """No token is made; rows are those of tokens one by one."""
    from assonance.functions.text import char_tokens
    from assonance.operators.documents import all_phonemes, spoken_characters, unknown_tokens, voiced

    sounds = TableSounds({"a": ["", "", "", "x", "", "", "yz", ""], "b": ["", "", "", "", "", "", "", ""], "七": ["", "", "", "q", "", "", None, "r"], "𠀀": ["", "", "", "s", "", "", "", "t"]})
    texts = ["a b  c,七八\U00020000\U00020001é e\u0301 9½Ⅳ \x00", "", None, "   ", "〼〇□", "aab" * 20_000]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    docs = voiced(rows.select("doc_id", char_tokens(F.coalesce("text", F.lit(""))).alias("tokens")), sounds)
    each = docs.select("doc_id", F.size(all_phonemes(F.col("phon"))).cast("long"), F.size(unknown_tokens(F.col("phon"))).cast("long"), F.array_join(all_phonemes(F.col("phon")), ""))
    got = spoken_characters(rows, sounds)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect()))
    assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()
