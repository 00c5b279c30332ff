"""Token counts by byte-pair merging with a heap and a linked list.

The bytes of a pre-token are symbols in a doubly linked list, and every
adjacent pair that some merge joins is in a heap, lowest rank first and then
leftmost.  Popping the top joins two symbols and pushes the pairs of the new
one with its neighbours; entries of symbols that are gone are passed over.
The count is the initial symbols minus the merges; no identifiers are made.

Counts are the ``tokenizers`` library's for the same file, without special
tokens added; the file's own special strings inside a text are one token
each, as is that library's default.  A null or empty text has 0 tokens; a
very long text or word is counted whole, in n log n steps; repeated rows are
counted each for itself; an empty table gives no rows; further columns, also
of clashing names, stay inside ``row``.  Memory: one batch of texts, the heap
of one pre-token, and the counts of the latest words of up to ``SHORT``
characters, ``KEPT`` of them twice over.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.llm.batches import small_batches

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 200_000
#: Longer words are counted anew each time, so what is kept is bounded in bytes too.
SHORT = 64


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if it's printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class MergeCounter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model["pre_tokenizer"] or {}
        if model["model"]["type"] != "BPE" or model["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        names, number = _byte_names(), {}
        known = number.setdefault
        self.byte_symbol = [0] * 256
        for name, byte in names.items():
            self.byte_symbol[byte] = known(name, len(number))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = known(left, len(number)), known(right, len(number))
            self.merges.setdefault(pair, (rank, known(left + right, len(number))))
        special = [t["content"] for t in model["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError(f"added tokens that take in what is beside them: {path}")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN)
        self.mixed_blanks = re.compile(r" \s")
        self.fresh: dict[str, int] = {}
        self.stale: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols of one pre-token once nothing more can be merged."""
        symbol = [self.byte_symbol[b] for b in piece.encode("utf-8", "replace")]
        n, merges = len(symbol), self.merges
        if n < 2:
            return n
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            now = merges.get((symbol[i], symbol[j]))
            if not now or now[0] != rank:
                continue
            symbol[i], symbol[j] = joined, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = merges.get((joined, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], joined))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return left

    def _counted(self, text: str) -> int:
        return self.merged(text) if text[1:].isalpha() and text[0] == " " else sum(map(self.merged, self.pieces.findall(text)))

    def _piece(self, text: str) -> int:
        """Tokens of a stretch of text of which no pre-token reaches over its ends."""
        if len(text) > SHORT:
            return self._counted(text)
        n = self.fresh.get(text)
        if n is None:
            n = self.stale.get(text)
            if n is None:
                n = self._counted(text)
            if len(self.fresh) >= KEPT:
                self.stale, self.fresh = self.fresh, {}
            self.fresh[text] = n
        return n

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        # A space before another blank belongs to a run of blanks, which may go on over the next space.
        if text[0] == " " or self.mixed_blanks.search(text):
            return sum(map(self._piece, self.pieces.findall(text)))
        # Any other space starts a pre-token, so none reaches over it.
        first, *others = text.split(" ")
        return self._piece(first) + sum([self._piece(" " + x) for x in others])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special and self.special.search(text):
            found = len(self.special.findall(text))
            return found + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)


_COUNTERS: dict[str, MergeCounter] = {}


def _counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text as a long, for the vocabulary file at ``path`` on every worker."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for batch in batches:
            yield pa.array([counter.count(x) for x in batch.to_pylist()], pa.int64())

    return count(text)


def with_token_counts(documents: DataFrame, text: str, path: str, limit: int = 1024) -> DataFrame:
    """Columns ``row``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""
    small_batches(documents.sparkSession)
    counted = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col(f"`{text}`"), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
