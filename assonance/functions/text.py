"""Normalisation, tokens and token predicates as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that are deleted (every one but U+0020), and signs for lost characters.
DELETED = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LOST, LOST_AS = "□○", "〼〇"
#: Letters that Java 17's tables don't know yet: late CJK additions.
LATE_LETTERS = r"\x{9FFD}-\x{9FFF}\x{2EBF0}-\x{2EE5D}\x{31350}-\x{323AF}"


#: A token of letters, and one of numerals.
ALPHA, NUMBER = rf"^[\p{{L}}{LATE_LETTERS}]+$", r"^[\p{N}〇零一二三四五六七八九十百千萬万億亿兆]+$"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Arrays that cross an operator are stored flat, and each ``slice`` of such
    an array copies all of it.  What is computed here stays an object, and no
    rewriting of filters or projections computes it once per use.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def loose(array: Column) -> Column:
    """The same array as an object, for many slices of it."""
    return F.transform(array, lambda x: x)


def normalise(text: Column) -> Column:
    """Delete blanks but U+0020 and widen the signs for lost characters."""
    return F.translate(text, LOST + DELETED, LOST_AS)


def is_alpha(token: Column) -> Column:
    return token.rlike(ALPHA)


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)


def is_alnum(token: Column) -> Column:
    return token.rlike(rf"^[\p{{L}}\p{{N}}{LATE_LETTERS}]+$")


def char_tokens(text: Column) -> Column:
    """``array<struct<text,after>>``: each character; one space after a character belongs to it.

    What a run of spaces has beyond that one is a token of its own.
    """
    pieces = F.regexp_extract_all(text, F.lit("(?s)[^ ] ?| +"), F.lit(0))
    return F.transform(
        pieces,
        lambda p: F.when(
            (F.length(p) > 1) & ~p.startswith(" "), F.struct(F.substring(p, 1, 1).alias("text"), F.lit(" ").alias("after"))
        ).otherwise(F.struct(p.alias("text"), F.lit("").alias("after"))),
    )


def word_tokens(text: Column) -> Column:
    """``array<struct<text,after>>``: lower-cased runs of letters, as if one space stood between them."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.transform(found, lambda w: F.struct(w.alias("text"), F.lit(" ").alias("after")))


def span_text(tokens: Column, start: Column, end: Column) -> Column:
    """Text of tokens [start, end), without what follows the last one."""
    inner = F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0)))
    joined = F.array_join(F.transform(inner, lambda t: F.concat(t["text"], t["after"])), "")
    last = F.try_element_at(inner, F.lit(-1))["after"]
    return F.when(F.coalesce(last, F.lit("")) == "", joined).otherwise(F.substring(joined, F.lit(1), F.length(joined) - 1))


def ngram_starts(n_tokens: Column, order: int) -> Column:
    """Starts of the n-grams: a text shorter than ``order`` is one, an empty text has none."""
    return F.when(n_tokens > 0, F.sequence(F.lit(0), F.greatest(n_tokens - order, F.lit(0)))).otherwise(F.array().cast("array<int>"))
