import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assonance.llm import pieces, token_counts

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

ODD = [
    "", " ", "  ", "a  b", " a", "a \n b", "\n\n a", "it's you'll 'tis I'D", "x<|endoftext|>y <|endoftext|>", "½²Ⅷ12 3", "é", "日本語 テキスト",
    "a\x1cb \x1d c", "\t\tx", "a b", "a　　b", "😀 👍🏽", "a   ", "foo\n  bar", "ab" * 3000, "a\x85b", "a​b", "a▁b ▁", "\x00", "x" * 40_000,
]


@pytest.fixture(scope="module")
def library(vocabulary):
    return tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter(vocabulary):
    return token_counts.MergeCounter(vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_counts_of_odd_texts(counter, library, text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_of_any_text(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts._counter(path).count(text) == len(_library(path).encode(text, add_special_tokens=False).ids)


def test_counts_of_mixed_blanks(counter, library):
    """Spaces, tabs, line breaks and the blanks beyond ASCII in any mixture."""
    rng = random.Random(21)
    parts = [" ", " ", " ", "\t", "\n", "\r", "\xa0", "\u3000", "\x85", "\u2028", "\x1c", "a", "word", "12", ".", "é", "'s", "日本"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(50_000)]
    texts += ["\n \xa0 \xa0\x85", "\xa0 \xa0", "a \xa0 b"]
    told = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(x) for x in texts] == told


_LIBRARIES = {}


def _library(path):
    if path not in _LIBRARIES:
        _LIBRARIES[path] = tokenizers.Tokenizer.from_file(path)
    return _LIBRARIES[path]


def test_counts_as_columns(docs, no_docs, vocabulary, counter):
    path = vocabulary("byte_bpe_50k.json")
    rows = token_counts.with_token_counts(docs, "text", path).select("row.doc_id", "row.text", "row.n_tokens", F.col("n_tokens").alias("t"), "n_bytes", "over_limit").collect()
    assert len(rows) == 10 and {r["n_tokens"] for r in rows} == {7}
    for r in rows:
        assert (r["t"], r["n_bytes"], r["over_limit"]) == (counter.count(r["text"]), len((r["text"] or "").encode()), counter.count(r["text"]) > 1024)
    assert token_counts.with_token_counts(no_docs, "text", path).count() == 0


def test_memory_of_words_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 10)
    counter = token_counts.MergeCounter(vocabulary("byte_bpe_50k.json"))
    text = " ".join(f"word{i}" for i in range(200))
    assert counter.count(text) == counter.count(text) and len(counter.fresh) <= 10 and len(counter.stale) <= 10


def test_long_words_are_not_kept(vocabulary):
    counter = token_counts.MergeCounter(vocabulary("byte_bpe_50k.json"))
    counter.count("x" * 5000 + " " + "y" * 70)
    assert max(map(len, [*counter.fresh, ""])) <= token_counts.SHORT


@pytest.fixture(scope="module")
def codec(vocabulary):
    return pieces.PieceCodec.load(vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def processor(vocabulary):
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def test_pieces_are_the_library_s(codec, processor):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices("abcdetinsrh éß▁ \n.,!日ñ", k=rng.randint(1, 80))) for _ in range(400)]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        ids = np.frombuffer(ids, np.int32).tolist()
        assert ids == processor.encode(text), text
        assert codec.decode(ids) == processor.decode(ids) == text.replace("▁", " ")


def test_viterbi_finds_the_best_score():
    rng = random.Random(9)
    names = ["▁", *"abcd", *{"".join(rng.choices("abcd", k=rng.randint(2, 4))) for _ in range(40)}, "▁ab", "▁c"]
    scores = [-rng.random() * 10 for _ in names]
    codec = pieces.PieceCodec(["<unk>", *names], [0.0, *scores], ["unknown"] + ["normal"] * len(names), pieces.UNIGRAM)
    known, floor = dict(zip(names, scores, strict=True)), min(scores) - pieces.UNKNOWN_COST

    def best(word):
        top = [0.0] + [-1e9] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                piece = word[s:e]
                if piece in known or e - s == 1:
                    top[e] = max(top[e], top[s] + known.get(piece, floor))
        return top[-1]

    texts = ["".join(rng.choices("abcdx", k=rng.randint(1, 14))) for _ in range(300)]
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        ids = np.frombuffer(ids, np.int32).tolist()
        told = sum(floor if i == 0 else scores[i - 1] for i in ids)
        assert told == pytest.approx(best("▁" + text), abs=1e-3)
        assert 0 in ids or codec.decode(ids) == text


def test_pieces_as_columns(docs, no_docs, vocabulary, processor):
    path = vocabulary("piece_bpe_32k.model")
    frame = docs.select("doc_id", "text", pieces.encode(F.col("text"), path).alias("ids"))
    rows = frame.select("*", pieces.decode(F.col("ids"), path).alias("again")).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else processor.encode(r["text"])) and r["again"] == r["text"]
    assert no_docs.select(pieces.encode(F.col("text"), path)).count() == 0


def test_words_without_spaces(codec, processor):
    """Long words are merged by a heap; the ids are the library's, and 40,000 letters take no second."""
    rng = random.Random(12)
    letters = ["abcdet", "日本語中a", "aab", "thein", "ab😀", "ABCDabcd0123+/"]
    words = ["".join(rng.choices(rng.choice(letters), k=rng.randint(pieces.LONG - 3, 300))) for _ in range(600)]
    words += ["".join(rng.choices(x, k=40_000)) for x in letters]
    texts = [*words, words[0] + " and " + words[1]]
    began = time.perf_counter()
    found = codec.encode_batch(texts)
    assert time.perf_counter() - began < 10
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == processor.encode(texts)
    assert max(map(len, [*codec.fresh, ""])) <= pieces.LONG and not codec.passing


def test_decoding_in_batches(codec, processor):
    rng = random.Random(5)
    rows = [[rng.randrange(3, processor.vocab_size()) for _ in range(rng.randint(0, 50))] for _ in range(300)] + [[], [1, 2, 5]]
    flat = np.array([i for r in rows for i in r], np.int32)
    assert codec.decode_batch(flat, np.cumsum([0, *map(len, rows)])) == [codec.decode(r) for r in rows]
    assert codec.decode_batch(np.zeros(0, np.int32), np.array([0])) == []


def test_round_trip_in_one_pass(docs, no_docs, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    one = docs.where("doc_id <> 6 and doc_id is not null")
    told = {r[0]: (r[1], r[2]) for r in one.select("doc_id", F.md5("text"), pieces.encode(F.col("text"), path)).collect()}
    both = pieces.round_trip(one, path, keep=["doc_id", "n"]).collect()
    assert len(both) == 7 and all((r["decoded_md5"], r["ids"]) == told[r["doc_id"]] and r["n_pieces"] == len(r["ids"] or ()) and r["n"] == 7 for r in both)
    assert pieces.round_trip(docs, path).count() == 10 and pieces.round_trip(no_docs, path).count() == 0
