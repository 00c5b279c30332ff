"""Periodic runs of words by Lyndon words.

A run is a stretch with a smallest period that no neighbouring word extends.
The first period of a run holds a word that is the longest Lyndon word from
its place under an order of words or under the reverse of it.  So a stack is
scanned from right to left under both orders: it holds the places where the
longest Lyndon words end (next smaller suffixes).  Suffixes that start alike
are told apart by their longest common extension: a few words directly, then
by doubling and binary search over prefix hashes, and what the hashes call
equal is compared word by word, once for each stretch and distance.  Only
places whose Lyndon word stands there twice are extended to both sides; there
is no suffix array.

A null text has no words, as an empty one; very long texts are read whole, in
some n log n steps, as are texts of one word repeated; repeated rows are read
each for itself; an empty table gives no rows; further columns stay inside
``row`` and may have any names.  Memory: one batch of texts, and some 200 bytes
for each word of the text at hand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.llm.batches import small_batches

#: Words that are compared one by one before hashes are asked.
DIRECT = 8
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Fixed value: the blanks between words; those of ``bytes.split``.
BLANKS = r"[\x20\x09-\x0D]+"


class Extensions:
    """Longest common extensions of one sequence of numbers."""

    def __init__(self, word: np.ndarray) -> None:
        self.word, self.n = word, len(word)
        self.mixed = self.power = None
        #: For each distance, the stretch in which words that far apart are known to be identical.
        self.known: dict[int, tuple[int, int]] = {}

    def _hashes(self) -> None:
        x = self.word.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.uint64(1)
        power = np.ones(self.n + 1, np.uint64)
        np.multiply.accumulate(np.full(self.n, BASE, np.uint64), out=power[1:])
        prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x * power[:-1], out=prefix[1:])
        self.mixed, self.power = prefix.tolist(), power.tolist()

    def _same(self, i: int, j: int, size: int) -> bool:
        """By hash whether ``size`` words from i are those from j; false is certain."""
        h = self.mixed
        return ((h[i + size] - h[i]) * self.power[j - i] - (h[j + size] - h[j])) & MASK == 0

    def _verified(self, i: int, size: int, gap: int) -> int:
        """How many of ``size`` words from i are those ``gap`` further on, compared word by word."""
        a, b = self.known.get(gap, (i, i))
        if not (a <= i + size and i <= b):
            a = b = i
        for start, end in ((i, min(a, i + size)), (max(b, i), i + size)):
            if start < end:
                differ = np.nonzero(self.word[start:end] != self.word[start + gap : end + gap])[0]
                if len(differ):
                    return start + int(differ[0]) - i
        self.known[gap] = min(a, i), max(b, i + size)
        return size

    def forward(self, i: int, j: int, equal: int = 0) -> int:
        """Words from i that equal those from j > i; ``equal`` of them are known to."""
        most, gap = self.n - j, j - i
        a, b = self.known.get(gap, (0, -1))
        if a - equal <= i <= b:
            # The known stretch goes on from here; only what lies behind it is open.
            size = b - i
            if size >= most or self.word[i + size] != self.word[j + size]:
                self.known[gap] = min(a, i), b
                return size
        if self.mixed is None:
            self._hashes()
        low, high = 0, min(max(equal, DIRECT), most)
        while high < most and self._same(i, j, high):
            low, high = high, min(2 * high, most)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._same(i, j, middle) else (low, middle - 1)
        return self._verified(i, low, gap)

    def backward(self, i: int, j: int) -> int:
        """Words before i that equal those before j > i."""
        if self.mixed is None:
            self._hashes()
        low, high = 0, min(DIRECT, i)
        while high < i and self._same(i - high, j - high, high):
            low, high = high, min(2 * high, i)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._same(i - middle, j - middle, middle) else (low, middle - 1)
        # A hash may call unequal words equal; then the last words that differ end the extension.
        differ = np.nonzero(self.word[i - low : i] != self.word[j - low : j])[0]
        return low - int(differ[-1]) - 1 if len(differ) else low


def next_smaller(word: Sequence[int], extensions: Extensions) -> list[int]:
    """For each place the first later one whose suffix is smaller: where the longest Lyndon word from there ends.

    An ended suffix is smaller than any that goes on.
    """
    n = len(word)
    ends = [n] * n
    known, forward = [*word, None], extensions.forward
    for i in range(n - 2, -1, -1):
        x, j = known[i], i + 1
        while j < n:
            y = known[j]
            if x > y:
                break
            if x == y:
                k, most = 1, n - j
                while k < most and k < DIRECT and known[i + k] == known[j + k]:
                    k += 1
                if k == DIRECT and k < most:
                    k = forward(i, j, k)
                if k >= most or known[i + k] > known[j + k]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(word: Sequence[int], least: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``periods`` (3 or more) periods, by start, then period.

    ``word``: numbers, equal for equal words.
    """
    if periods < 3:
        raise ValueError("a run of under three periods needn't show its Lyndon word twice")
    n = len(word)
    if n < least:
        return []
    array = np.asarray(word, np.int64)
    extensions, found = Extensions(array), set()
    place = np.arange(n)
    for order in (word, (-array).tolist()):
        ends = np.array(next_smaller(order, extensions))
        # A run of three periods shows a Lyndon word twice: the first words tell most other places apart.
        maybe = place[2 * ends - place <= n]
        for k in range(4):
            period = ends[maybe] - maybe
            maybe = maybe[(period <= k) | (array[maybe + np.minimum(k, period - 1)] == array[ends[maybe] + np.minimum(k, period - 1)])]
        done: dict[int, tuple[int, int]] = {}
        for i in maybe.tolist():
            end = int(ends[i])
            period = end - i
            start, stop = done.get(period, (0, 0))
            if start <= i and end + period <= stop:
                continue
            ahead = extensions.forward(i, end)
            if ahead < period:
                continue
            start, stop = i - extensions.backward(i, end), end + ahead
            done[period] = start, stop
            if stop - start >= max(least, periods * period):
                found.add((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_places(n: int, runs: Sequence[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of the n words that no run repeats: all but what lies behind the first period of some run."""
    out, at = [], 0
    for start, end in sorted((s + q, s + size) for s, size, q in runs):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, n)] if at < n else out


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("periods", pa.list_(pa.int64())), ("collapsed", pa.string()),
])


def with_runs(documents: DataFrame, text: str | Column = "text", least: int = 24, periods: int = 3) -> DataFrame:
    """Columns ``row``, ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed``.

    ``collapsed`` has, joined by single spaces, the words that don't repeat
    what stands one period before them in a run.
    """
    small_batches(documents.sparkSession)

    @F.arrow_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            # As bytes: their order is that of code points, and they split at ASCII blanks only.
            for told in batch.cast(pa.binary()).to_pylist():
                words = (told or b"").split()
                number: dict[bytes, int] = {}
                known = number.setdefault
                runs = runs_of([known(w, len(number)) for w in words], least, periods)
                kept = [w for a, b in kept_places(len(words), runs) for w in words[a:b]] if runs else words
                for column, value in zip(columns, (len(words), *([r[k] for r in runs] for k in range(3)), b" ".join(kept)), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns[:4], [f.type for f in _RESULT][:4], strict=True)]
            yield pa.StructArray.from_arrays([*arrays, pa.array(columns[4], pa.binary()).cast(pa.string())], fields=list(_RESULT))

    whole = F.col(f"`{text}`") if isinstance(text, str) else text
    told = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), found(whole).alias("f"))
    runs = F.zip_with(F.arrays_zip(F.col("f.starts").alias("start"), F.col("f.lengths").alias("length")), "f.periods", lambda a, q: F.struct(a["start"].alias("start"), a["length"].alias("length"), q.alias("period")))
    return told.select("row", "f.n_words", runs.alias("runs"), "f.collapsed")


def densest(runs: Column) -> Column:
    """The run of the greatest length by period, of ties the first; null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_planted_run(id: Column, text: Column) -> Column:
    """The text, and for a tenth of the ids the text with its end made periodic.

    With h the CRC-32 of the id in decimal digits and g = h // 10, a tenth are
    the ids of h % 10 = 0: word i from a = g % n on becomes word a + (i - a) % p
    of the n words, p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.encode(id.cast("string"), "utf-8"))
    g = F.floor(h / 10)

    def moved(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        part = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        turns = F.flatten(F.array_repeat(part, (F.floor((n - a) / p) + 1).cast("int")))
        return F.when(n == 0, text).otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(turns, F.lit(1), (n - a).cast("int"))), " "))

    # As the one element of an array, the words are cut once for all that reads them.
    words = F.array(F.filter(F.split(text, BLANKS), lambda w: w != ""))
    return F.when(h % 10 == 0, F.element_at(F.transform(words, moved), 1)).otherwise(text)
