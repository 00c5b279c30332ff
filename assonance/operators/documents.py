"""Documents: an ordered corpus with tokens and their sounds.

Columns: ``doc_id``, ``doc_ord`` (0 is the largest document, or the first line
of JSON Lines), ``tokens`` array<struct<text,after>>, ``phon``
array<array<string>> (null for an unvoiced token) and ``syll`` array<string>.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.functions.sounds import UNKNOWN, Sounds
from assonance.functions.text import char_tokens, word_tokens
from assonance.plans.batches import bounded_batches
from assonance.plans.durable import durable
from assonance.plans.joins import bounded_join
from assonance.plans.ordinal import with_ordinal

#: Ids that are broadcast with their ordinals, some 40 bytes each.
ORDINALS = 1_000_000
TOKENISERS = {"char": char_tokens, "word": word_tokens}


def make_documents(corpus: DataFrame, sounds: Sounds, tokeniser: str = "char", checked: bool = True) -> DataFrame:
    """Documents of a corpus (``id``, ``text``, ``size``, ``place``); ids must be given, and each only once."""
    order = F.desc("size"), F.asc("place"), F.asc("id")
    if checked:
        check_ids(corpus)
        # Ids are sorted without their texts, which then are neither shuffled nor stored if the ids are few enough.
        places = durable(with_ordinal(corpus.select("id", "size", "place"), "doc_ord", *order).select("id", "doc_ord"))
        ordered = bounded_join(corpus.select("id", "text"), places, ["id"], "inner", places.count(), limit=ORDINALS)
    else:
        ordered = with_ordinal(corpus.select("id", "text", "size", "place"), "doc_ord", *order)
    return voiced(ordered.select(F.col("id").alias("doc_id"), "doc_ord", TOKENISERS[tokeniser](F.col("text")).alias("tokens")), sounds)


def check_ids(corpus: DataFrame) -> None:
    bad = corpus.groupBy("id").count().where(F.col("id").isNull() | (F.col("id") == "") | (F.col("count") > 1)).head()
    if bad:
        raise ValueError(f"document id {bad['id']!r} is missing or given more than once")


def voiced(documents: DataFrame, sounds: Sounds) -> DataFrame:
    """Add ``phon`` and ``syll`` to tokens."""
    return documents.withColumn("phon", F.transform("tokens", lambda t: sounds.token_phonemes(t["text"]))).withColumn(
        "syll", F.transform("tokens", lambda t: sounds.syllable(t["text"]))
    )


def all_phonemes(phon: Column) -> Column:
    """Phonemes of tokens in a row, without empty ones; unvoiced tokens have none."""
    return F.filter(F.flatten(F.filter(phon, lambda p: p.isNotNull())), lambda x: x.isNotNull() & (x != ""))


def unknown_tokens(phon: Column) -> Column:
    return F.filter(phon, lambda p: p.isNotNull() & F.array_contains(p, UNKNOWN))


def transcription(syllables: Column) -> Column:
    return F.concat(F.lit("*"), F.array_join(syllables, " "))


class _Spoken(dict):
    """What is said for each character; nothing for those that have no sound."""

    def __missing__(self, character: int) -> None:
        self[character] = None


def spoken_characters(texts: DataFrame, sounds: Sounds) -> DataFrame:
    """``doc_id``, ``n_phonemes``, ``n_unknown`` and ``phonemes`` (in one) of each ``text`` read as characters, as ``voiced`` and ``all_phonemes`` give them.

    A token of characters is one character, or spaces without a sound.  So each
    character of Unicode is looked up once, and a text is translated by what
    was found: some 140,000 characters at most, however many texts there are.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    every = spark.range(0x110000).where(~F.col("id").between(0xD800, 0xDFFF))
    sign = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    tokens = F.array(F.struct(sign.alias("text"), F.lit("").alias("after")))
    read = voiced(every.select("id", tokens.alias("tokens")), sounds).where(F.col("phon")[0].isNotNull())
    found = read.select("id", all_phonemes(F.col("phon")).alias("said"), (F.size(unknown_tokens(F.col("phon"))) > 0).alias("unknown")).toArrow()
    ids, said, unknown = (found.column(i).to_pylist() for i in range(3))
    spoken = dict(zip(ids, map("".join, said), strict=True))
    numbers = {chr(i): (len(x), int(y)) for i, x, y in zip(ids, said, unknown, strict=True)}
    told = spark.sparkContext.broadcast((spoken, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spoken, numbers = _Spoken(told.value[0]), told.value[1]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                held = [(n, *numbers[c]) for c, n in Counter(text or "").items() if c in numbers]
                rows.append((sum(n * size for n, size, _ in held), sum(n * unknown for n, _, unknown in held), (text or "").translate(spoken)))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_phonemes", "n_unknown", "phonemes"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id string, n_phonemes long, n_unknown long, phonemes string")
