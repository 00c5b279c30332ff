"""Inverted indexes as tables of postings.

An index is one row per value: ``key``, ``doc_id``, ``doc_ord``, ``start``,
``end`` and what else the value needs.  Nothing gathers a posting list but
``postings`` and ``lookup``, whose results are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.functions.sounds import BREAK, PART, UNKNOWN, Sounds
from assonance.functions.text import LATE_LETTERS, bind, char_tokens, is_alpha, loose, ngram_starts
from assonance.plans.durable import durable
from assonance.plans.joins import HOT_ROWS, bounded_join
from assonance.plans.sieve import sifted


def ngrams(documents: DataFrame, order: int, parts: tuple[str, ...] = ("tokens", "phon")) -> DataFrame:
    """Every n-gram of every document: ``doc_id``, ``doc_ord``, ``start``, ``end``, and of the document's arrays the slices ``parts``."""

    def grams(d: Column) -> Column:
        part = lambda c, i: F.slice(d[c], i + 1, F.lit(order)).alias(c)
        gram = lambda i: F.struct(i.alias("start"), F.least(i + order, d["size"]).alias("end"), *[part(c, i) for c in parts])
        return F.transform(ngram_starts(d["size"], order), gram)

    made = bind(F.struct(F.size("tokens").alias("size"), *[loose(F.col(c)).alias(c) for c in parts]), grams)
    # The outer kind only: for the other one a filter would be inferred that makes all grams a second time.
    return documents.select("doc_id", "doc_ord", F.explode_outer(made).alias("g")).where(F.col("g").isNotNull()).select("doc_id", "doc_ord", "g.*")


def build_index(values: DataFrame, key: Column, keep: Column | None = None) -> DataFrame:
    """Extension point: an index over any values (rows with ``doc_id``, ``doc_ord``, ``start``, ``end``)."""
    kept = values if keep is None else values.where(keep)
    return kept.withColumn("key", key)


def phonetic_index(documents: DataFrame, order: int, spaces_break: bool = True, sounds: Sounds | None = None, parts: tuple[str, ...] = ("text", "sound")) -> DataFrame:
    """N-grams by their sounds: those of letters only, of which every token's sound is known.

    ``key`` are the joined phonemes; ``text`` the written tokens and ``sound``
    the phoneme tuples of the tokens, each as one string with ``BREAK`` between
    tokens.  Only what ``parts`` names is made; a key alone is enough to count.
    Unless ``spaces_break`` is off (words), a space inside an n-gram keeps it
    out, as it isn't a letter.  With ``sounds`` a token's phonemes come from its
    text, else from the documents' ``phon``.

    A token that can't stand in an n-gram has a null for its sound, and a
    null in a concatenation is the whole n-gram's: so each n-gram is one
    concatenation of neighbours, and no array is sliced.
    """
    if sounds is None:
        fine = lambda t, p: is_alpha(t["text"]) & p.isNotNull() & ~F.coalesce(F.array_contains(p, UNKNOWN), F.lit(False))
        tuple_ = lambda p: F.array_join(F.transform(p, lambda x: F.coalesce(x, F.lit("\u0000"))), PART)
        spoken = F.zip_with("tokens", "phon", lambda t, p: F.when(fine(t, p), F.array_join(p, "")))
        whole = F.transform("phon", tuple_)
    else:
        spoken = F.transform("tokens", lambda t: sounds.spoken(t["text"]))
        whole = F.transform("tokens", lambda t: F.coalesce(sounds.whole(t["text"]), F.lit("")))
    per_token = F.struct(spoken.alias("key"), F.transform("tokens", lambda t: t["text"]).alias("text"), whole.alias("sound"))
    wanted = ["key", *parts]
    per_token = F.struct(*[per_token[c].alias(c) for c in wanted], *([F.transform("tokens", lambda t: t["after"] != "").alias("spaced")] if spaces_break and order > 1 else []))

    def grams(d: Column) -> Column:
        size = F.size(d["key"])

        def joined(c: str, i: Column, between: str) -> Column:
            pieces = []
            for j in range(order):
                if between and j:
                    pieces.append(F.lit(between))
                one = F.get(d[c], i + j)
                if c == "key" and spaces_break and j < order - 1:
                    one = F.when(~F.get(d["spaced"], i + j), one)
                pieces.append(one)
            return F.concat(*pieces)

        def gram(i: Column) -> Column:
            between = {"key": "", "text": BREAK, "sound": BREAK}
            return F.struct(i.alias("start"), (i + order).alias("end"), *[joined(c, i, between[c]).alias(c) for c in wanted])

        inner = F.slice(d["spaced"], 1, F.greatest(size - 1, F.lit(0))) if spaces_break and order > 1 else None
        fit = F.forall(d["key"], lambda x: x.isNotNull())
        fit = fit if inner is None else fit & ~F.exists(inner, lambda x: x)
        short = F.struct(
            F.lit(0).alias("start"), size.alias("end"), F.when(fit, F.array_join(d["key"], "")).alias("key"), *[F.array_join(d[c], BREAK).alias(c) for c in parts]
        )
        many = F.transform(F.sequence(F.lit(0), F.greatest(size - order, F.lit(0))), gram)
        return F.filter(F.when(size >= order, many).when(size > 0, F.array(short)), lambda g: g["key"].isNotNull())

    # Grams are made within the row of a document and only then become rows, which don't carry the document.
    each = documents.select("doc_id", "doc_ord", F.explode_outer(bind(per_token, grams)).alias("g"))
    kept = each.where(F.col("g").isNotNull()).select("doc_id", "doc_ord", "g.*")
    return build_index(kept, F.col("key"))


def number_of_keys(index: DataFrame) -> int:
    return index.agg(F.countDistinct("key")).first()[0]


def number_of_values(index: DataFrame) -> int:
    return index.count()


def contains(index: DataFrame, key: str) -> bool:
    return bool(index.where(F.col("key") == key).limit(1).count())


def lookup(index: DataFrame, key: str) -> DataFrame:
    """Values of one key in the order of documents and places."""
    return index.where(F.col("key") == key).orderBy("doc_ord", "start")


def in_order(index: DataFrame) -> DataFrame:
    """Keys with their number of values, in the order in which they are first seen."""
    place = F.min(F.struct("doc_ord", "start")).alias("first")
    return index.groupBy("key").agg(place, F.count("*").alias("n")).orderBy("first")


def postings(index: DataFrame, place: tuple[str, ...] = ("doc_ord", "start", "doc_id")) -> DataFrame:
    """``key``, ``first`` (where it is first seen), ``places`` in order, ``n`` and ``n_docs``; a whole list is one row.

    Values are shuffled as rows, ``key`` and ``place`` alone, and only then
    gathered: lists of one value each would be several times as large.
    """
    rows = index.select("key", *place).repartition("key")
    lists = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("places"))
    first = F.element_at("places", 1)
    document = place[-1] if "doc_id" in place else "doc_ord"
    return lists.select(
        "key", F.struct(first["doc_ord"].alias("doc_ord"), first["start"].alias("start")).alias("first"), "places",
        F.size("places").cast("long").alias("n"), F.size(F.array_distinct(F.transform("places", lambda p: p[document]))).alias("n_docs"),
    )


def total_counts(index: DataFrame) -> DataFrame:
    """One row: ``n_keys`` and ``n_values``.

    Keys are told apart by 96 bits of hashes, which are shorter than most
    keys: two keys would have to share both to count as one.
    """
    keys = index.groupBy(F.xxhash64("key").alias("a"), F.hash("key").alias("b")).agg(F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_values"))


def char_key_counts(texts: DataFrame, order: int, sounds: Sounds) -> DataFrame:
    """``key`` and ``n`` of the index of the characters of ``text``, each different stretch of letters looked at once.

    No n-gram goes over a space or a sign that isn't a letter, so each lies in
    one stretch of letters.  Only a text of fewer tokens than ``order`` is an
    n-gram as a whole; it has fewer characters that aren't spaces.
    """
    text = F.col("text")
    stretches = F.regexp_extract_all(text, F.lit(rf"[\p{{L}}{LATE_LETTERS}]{{{order},}}"), F.lit(0))
    runs = texts.select(F.explode(stretches).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    short = texts.where(F.length(F.replace(text, F.lit(" "), F.lit(""))) < order).select("text", F.lit(1).cast("long").alias("n"))
    # How often a stretch stands in the texts goes along as its number.
    stand_ins = runs.union(short).select(text.alias("doc_id"), F.col("n").alias("doc_ord"), char_tokens(text).alias("tokens"))
    return phonetic_index(stand_ins, order, sounds=sounds, parts=()).groupBy("key").agg(F.sum("doc_ord").alias("n"))


def key_counts(index: DataFrame) -> DataFrame:
    """``key``, ``n``, ``low_doc``, ``high_doc``, ``low_text``, ``high_text`` (hashes of the written forms).

    All but the key are numbers, so the aggregation keeps them in place.  Two
    forms of one key would have to share a 64-bit hash to look like one.
    """
    text = F.xxhash64("text") if "text" in index.columns else F.lit(0).cast("long")
    return index.groupBy("key").agg(
        F.count("*").alias("n"), F.min("doc_ord").alias("low_doc"), F.max("doc_ord").alias("high_doc"), F.min(text).alias("low_text"), F.max(text).alias("high_text")
    )


def keys_where(index: DataFrame, having: Column) -> DataFrame:
    """Values of the keys of which ``having`` holds over the columns of ``key_counts``."""
    # One aggregation tells both which keys are kept and which are hot; the latter are dealt out whether they are kept or not.
    found = durable(key_counts(index).withColumn("kept", having).where(F.col("kept") | (F.col("n") > HOT_ROWS)).select("key", "n", "kept"))
    keys = found.where("kept").select("key")
    return bounded_join(index, keys, ["key"], "left_semi", keys.count(), spread=F.xxhash64("doc_ord", "start"), counts=found.select("key", "n"))


def values_to_meet(index: DataFrame, forms: bool = False) -> DataFrame:
    """Values of all keys that stand in more than one document (and, with ``forms``, are written in more than one way), and few others.

    Keys are told apart by hashes, and the others are sifted out where the
    index is made, so that neither the index nor its keys are shuffled.  Some
    keys pass that have no right to: what joins the values must bear that.
    """
    text = {"low_text": F.min(F.xxhash64("text")), "high_text": F.max(F.xxhash64("text"))} if forms else {}
    seen = {"low_doc": F.min("doc_ord"), "high_doc": F.max("doc_ord"), **text}
    met = F.col("low_doc") < F.col("high_doc")
    met = met & (F.col("low_text") < F.col("high_text")) if forms else met
    found = durable(index.groupBy(F.xxhash64("key").alias("hash")).agg(*[c.alias(n) for n, c in seen.items()]).where(met).select("hash"))
    return sifted(index, F.xxhash64("key"), found, found.count())
