"""Graphemes to phonemes as columns.

A token has one of three states: unvoiced (neither letters nor a number),
which has no phonemes; unknown, which has the one phoneme ``UNKNOWN``; and
voiced, which has the selected segments of its reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from assonance.functions.text import ALPHA, NUMBER, is_alpha, is_number

#: Stands for the sound of a token that no table knows; a private-use character.
UNKNOWN = "\ue000"
#: Initial, nucleus and coda among the segments of a reading.
SELECTED = (3, 6, 7)
BUCKETS = 512
#: Stands between the phonemes of a token, and (the other) between tokens.
PART, BREAK = "\u001f", "\u001e"


def _quoted(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"CAST(unhex('{value.encode().hex()}') AS STRING)"


@dataclass(frozen=True)
class Sounds:
    """A phonetic system: two columns of a token."""

    def reading(self, token: Column) -> Column:
        """All segments as array<string>; null for an unknown token."""
        raise NotImplementedError

    def selected(self, segments: Column) -> Column:
        raise NotImplementedError

    def is_unknown(self, token: Column) -> Column:
        return self.reading(token).isNull()

    def is_voiced(self, token: Column) -> Column:
        return is_alpha(token) | is_number(token)

    def reading_sql(self) -> str:
        """``reading`` of ``token`` as SQL."""
        raise NotImplementedError

    def selected_sql(self, segments: str) -> str:
        """``selected`` as SQL."""
        return segments

    def token_phonemes(self, token: Column) -> Column:
        """Selected segments; ``[UNKNOWN]`` if unknown; null if unvoiced."""
        known = self.reading(token)
        voiced = F.when(known.isNull(), F.array(F.lit(UNKNOWN))).otherwise(self.selected(known))
        return F.when(self.is_voiced(token), voiced)

    def spoken(self, token: Column) -> Column:
        """The phonemes of a token of letters in one; null for any other token and for an unknown one."""
        known = self.reading(token)
        return F.when(is_alpha(token) & known.isNotNull(), F.array_join(self.selected(known), ""))

    def whole(self, token: Column) -> Column:
        """The phonemes of a known token as one string that keeps them apart; equal for tokens of one sound."""
        return F.array_join(F.transform(self.selected(self.reading(token)), lambda x: F.coalesce(x, F.lit("\u0000"))), PART)

    def syllable(self, token: Column) -> Column:
        """The whole reading in one, empty if unknown."""
        return F.coalesce(F.array_join(self.reading(token), ""), F.lit(""))


@dataclass(frozen=True)
class TableSounds(Sounds):
    """A table grapheme -> segments, of up to some 100,000 entries.

    It goes into the plan as an array of small maps, one per hash of the
    grapheme, so that a look-up costs the same at every table size.
    """

    table: Mapping[str, Sequence[str | None]]
    select: Sequence[int] | None = SELECTED
    _sql: str = field(default="", init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
        for grapheme, segments in self.table.items():
            parts = ", ".join(map(_quoted, segments))
            buckets[zlib.crc32(grapheme.encode()) % BUCKETS].append(f"{_quoted(grapheme)}, CAST(array({parts}) AS ARRAY<STRING>)")
        maps = (f"map({', '.join(b)})" if b else "CAST(map() AS MAP<STRING, ARRAY<STRING>>)" for b in buckets)
        object.__setattr__(self, "_sql", f"array({', '.join(maps)})")

    def reading(self, token: Column) -> Column:
        bucket = F.element_at(F.expr(self._sql), (F.crc32(F.coalesce(token, F.lit(""))) % BUCKETS).cast("int") + 1)
        return F.try_element_at(bucket, token)

    def selected(self, segments: Column) -> Column:
        return segments if self.select is None else F.array(*[F.try_element_at(segments, F.lit(i + 1)) for i in self.select])

    def reading_sql(self) -> str:
        return f"try_element_at(element_at({self._sql}, CAST(crc32(coalesce(token, '')) % {BUCKETS} AS INT) + 1), token)"

    def selected_sql(self, segments: str) -> str:
        return segments if self.select is None else f"array({', '.join(f'try_element_at({segments}, {i + 1})' for i in self.select)})"

    def empty_size(self) -> int:
        """Segments of the table's first entry: the arity of an unvoiced token's empty phonemes."""
        return len(next(iter(self.table.values()), ()))


@dataclass(frozen=True)
class LetterSounds(Sounds):
    """Words of an alphabet: each letter is read as its class, and a word with other letters is unknown."""

    letters: str
    classes: str

    def reading(self, token: Column) -> Column:
        return F.when(self.is_known(token), F.array(F.translate(token, self.letters, self.classes)))

    def selected(self, segments: Column) -> Column:
        return segments

    def reading_sql(self) -> str:
        return f"CASE WHEN token RLIKE '^[{self.letters}]+$' THEN array(translate(token, '{self.letters}', '{self.classes}')) END"

    def token_phonemes(self, token: Column) -> Column:
        # A word of known letters is voiced, so most words need one test.
        return F.when(self.is_known(token), F.array(F.translate(token, self.letters, self.classes))).when(self.is_voiced(token), F.array(F.lit(UNKNOWN)))

    def spoken(self, token: Column) -> Column:
        # Its letters are letters, so one test does.
        return F.when(self.is_known(token), F.translate(token, self.letters, self.classes))

    def whole(self, token: Column) -> Column:
        return F.translate(token, self.letters, self.classes)

    def is_known(self, token: Column) -> Column:
        return token.rlike(f"^[{self.letters}]+$")


# Latin letters, and below each the class as which it is read.
LATIN = LetterSounds(
    "abcdefghijklmnopqrstuvwxyz" + "àáâäãå" + "ç" + "èéêë" + "ìíîï" + "ñ" + "òóôöõ" + "ùúûü" + "ÿ",
    "abkdefghijklmnopkrstuvwxis" + "aaaaaa" + "s" + "eeee" + "iiii" + "n" + "ooooo" + "uuuu" + "i",
)


#: Letters by rough class: vowels alike, voiced and unvoiced consonants alike.
SKELETON = LetterSounds(
    LATIN.letters,
    "".join(
        next((c for members, c in (("aeiouàáâäãåèéêëìíîïòóôöõùúûüyÿ", "a"), ("bp", "p"), ("dt", "t"), ("cgkqç", "k"), ("mnñ", "n"), ("sxz", "s"), ("fvw", "f"), ("lr", "l"), ("hj", "h")) if x in members), x)
        for x in LATIN.letters
    ),
)


def register(spark: SparkSession, sounds: Sounds, prefix: str = "g2p_") -> list[str]:
    """SQL functions of tokens for this session: ``reading``, ``phonemes``, ``syllable``, ``is_voiced``, ``is_unknown`` and ``variants`` (of two).

    They are SQL themselves, so calls of them are optimized like any other expression.  The names made are given back.
    """
    letters, numbers = rf"r'{ALPHA}'", rf"r'{NUMBER}'"
    known = f"{prefix}reading(token)"
    same = f"{prefix}phonemes(a) IS NOT NULL AND to_json(struct({prefix}phonemes(a))) = to_json(struct({prefix}phonemes(b)))"
    made = {
        "reading": ("token STRING", "ARRAY<STRING>", sounds.reading_sql()),
        "is_voiced": ("token STRING", "BOOLEAN", f"token RLIKE {letters} OR token RLIKE {numbers}"),
        "is_unknown": ("token STRING", "BOOLEAN", f"{known} IS NULL"),
        "phonemes": ("token STRING", "ARRAY<STRING>", f"CASE WHEN {prefix}is_voiced(token) THEN CASE WHEN {known} IS NULL THEN array('{UNKNOWN}') ELSE {sounds.selected_sql(known)} END END"),
        "syllable": ("token STRING", "STRING", f"coalesce(array_join({known}, ''), '')"),
        "variants": ("a STRING, b STRING", "BOOLEAN", f"coalesce(NOT {prefix}is_unknown(a) AND NOT {prefix}is_unknown(b) AND a <> b AND {same}, false)"),
    }
    for name, (takes, gives, value) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURNS {gives} RETURN {value}")
    return [prefix + name for name in made]


def are_graphic_variants(sounds: Sounds, first: Column, *others: Column) -> Column:
    """Voiced and known tokens of one sound, each other than the first in writing."""
    known = lambda t: sounds.is_voiced(t) & ~sounds.is_unknown(t)
    same = lambda a, b: F.to_json(F.struct(sounds.token_phonemes(a).alias("p"))) == F.to_json(F.struct(sounds.token_phonemes(b).alias("p")))
    out = known(first)
    for other in others:
        out = out & known(other) & same(first, other) & (first != other)
    return F.coalesce(out, F.lit(False))
