"""SentencePiece encoding and decoding with batched numpy kernels.

A text is normalised as the model says for the identity rule (spaces become
U+2581, one is put in front) and cut before each run of U+2581; no piece
reaches over such a cut, so words are encoded each for itself.  Words that
aren't known yet are sorted by length, and all words of one length advance
together as the rows of a matrix.  The pieces are kept as sorted 64-bit
hashes; the hash of any substring comes from the prefix hashes of its row in
one step and is probed by binary search.

* A unigram model is decoded by Viterbi: for each end the scores of all piece
  lengths are compared, and the vectorised maximum stores a backpointer.
* A BPE model isn't a shortest-path problem (its segmentation is defined by
  the order of merges, so maximal score sums give other pieces), and for such
  files the same matrix advances by merges: every pair of neighbours is one
  substring probe, the vectorised maximum (leftmost on ties) is merged.
  Words of over ``LONG`` characters (scripts without spaces, encoded data)
  have few others of their length, and a matrix of them would cost their
  square: they are merged by a heap of pairs over a linked list instead.

Characters without a piece become their UTF-8 byte pieces if the model has
them, else the unknown piece.  A null text stays null and an empty one has no
pieces; a very long text is encoded whole, in n log n steps; repeated rows
are encoded each for itself; an empty table gives no rows; only the given
column is read, so further columns may have any names.  Decoding gives the
text back, but for U+2581 itself, which reads as a space, as in the library.
Memory: one batch of texts and their ids, and the pieces of up to ``KEPT``
words of at most ``LONG`` characters, twice over.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

SPACE = "▁"
KEPT = 150_000
LONG = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
#: What the library takes off the lowest score for an unknown character.
UNKNOWN_COST = 10.0
UNIGRAM, BPE = "unigram", "bpe"


def _mix(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)
    return h ^ (h >> np.uint64(32))


class PieceTable:
    """Pieces by the hash of their code points."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.ones(max(self.longest, 1) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(self.powers) - 1, BASE), out=self.powers[1:])
        keys = np.zeros(len(pieces), np.uint64)
        for n in {len(p) for p in pieces}:
            at = [i for i, p in enumerate(pieces) if len(p) == n]
            rows = self.prefixes(code_points([pieces[i] for i in at], n))
            keys[at] = self.hashes(rows, 0, n)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.scores = np.array(scores, np.float64)[self.order]

    @staticmethod
    def prefixes(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        for j in range(rows.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + rows[:, j] + np.uint64(1)
        return out

    def hashes(self, prefix: np.ndarray, start: int, end: int) -> np.ndarray:
        return _mix(prefix[:, end] - prefix[:, start] * self.powers[end - start], end - start)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the sorted keys, or -1."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, at, -1)


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length).astype(np.uint64)


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], algorithm: str) -> None:
        """``kinds``: for each piece ``normal``, ``byte``, ``control`` or ``unknown``."""
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.table = PieceTable([pieces[i] for i in normal], [scores[i] for i in normal])
        self.ids = np.array(normal, np.int32)[self.table.order]
        self.algorithm = algorithm
        self.unknown = kinds.index("unknown") if "unknown" in kinds else -1
        self.byte_ids = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.bytes_of = [None if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.place_of = {pieces[normal[j]]: place for place, j in enumerate(self.table.order.tolist())}
        self.fresh: dict[str, bytes] = {}
        self.stale: dict[str, bytes] = {}
        self.passing: dict[str, bytes] = {}
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*")

    @classmethod
    def load(cls, path: str, algorithm: str | None = None) -> PieceCodec:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        kind = lambda i: "byte" if lib.is_byte(i) else "control" if lib.is_control(i) else "unknown" if lib.is_unknown(i) else "normal"
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece reaches over a space, so words can't be encoded each for itself")
        return cls(pieces, [lib.get_score(i) for i in range(n)], [kind(i) for i in range(n)], algorithm or model_kind(model))

    # Words of one length

    def viterbi(self, words: list[str], length: int) -> list[list[int]]:
        """Places of the pieces of each word; -1 for a character without one."""
        table, n = self.table, len(words)
        prefix = table.prefixes(code_points(words, length))
        floor = table.scores.min(initial=0.0) - UNKNOWN_COST
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0.0
        back, place = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int64)
        for end in range(1, length + 1):
            # The library looks at long pieces first and lets a shorter one win only if it's better.
            for size in range(min(end, table.longest), 0, -1):
                at = table.probe(table.hashes(prefix, end - size, end))
                score = best[:, end - size] + np.where(at >= 0, table.scores[at], floor if size == 1 else -np.inf).astype(np.float32)
                better = score > best[:, end]
                best[better, end], back[better, end], place[better, end] = score[better], end - size, at[better]
        out = []
        for starts, places in zip(back.tolist(), place.tolist(), strict=True):
            end, found = length, []
            while end:
                found.append((places[end], starts[end]))
                end = starts[end]
            out.append(found[::-1])
        return [[(p, s) for p, s in row] for row in out]

    def merges(self, words: list[str], length: int) -> list[bytes]:
        """The ids of each word, by merging the best pair of neighbours of every row until no row has one."""
        table, n = self.table, len(words)
        prefix = table.prefixes(code_points(words, length))
        rows = np.arange(n)
        # Segment i of a row covers [start[i], start[i+1]); pair i is that substring with the next one.
        start = np.tile(np.arange(length + 2, dtype=np.int32), (n, 1))
        start[:, length + 1] = length
        count = np.full(n, length)
        score = np.full((n, length), -np.inf)

        def pair(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
            a, b = start[rows, i], start[rows, i + 2]
            size = b - a
            ok = (i + 1 < count[rows]) & (size <= table.longest)
            a, b, size = np.where(ok, a, 0), np.where(ok, b, 0), np.where(ok, size, 0)
            h = prefix[rows, b] - prefix[rows, a] * table.powers[size]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
            at = table.probe(h ^ (h >> np.uint64(32)))
            return np.where(ok & (at >= 0), table.scores[at], -np.inf)

        for i in range(length - 1):
            score[:, i] = pair(rows, np.full(n, i))
        live, columns = rows, np.arange(length + 1)
        while len(live):
            at = score[live].argmax(axis=1)
            some = score[live, at] > -np.inf
            live, at = live[some], at[some]
            if not len(live):
                break
            # Close the gap: boundary at+1 goes, and what is right of it moves one to the left.
            right = columns[None, :] > at[:, None]
            bounds, scores = start[live], score[live]
            bounds[:, :-1] = np.where(right[:, : length + 1], bounds[:, 1:], bounds[:, :-1])
            scores[:, :-1] = np.where(right[:, : length - 1], scores[:, 1:], scores[:, :-1])
            scores[:, -1] = -np.inf
            start[live], score[live] = bounds, scores
            count[live] -= 1
            score[live, at] = pair(live, at)
            left = at > 0
            score[live[left], at[left] - 1] = pair(live[left], at[left] - 1)
        r, c = np.nonzero(np.arange(length)[None, :] < count[:, None])
        a, b = start[r, c], start[r, c + 1]
        fits = (b - a) <= table.longest
        size = np.where(fits, b - a, 0)
        h = prefix[r, b] - prefix[r, a] * table.powers[size]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        place = np.where(fits, table.probe(h ^ (h >> np.uint64(32))), -1)
        ends = np.cumsum(count).tolist()
        data = self.ids[place].tobytes()
        out = [data[4 * x : 4 * y] for x, y in zip([0, *ends], ends, strict=False)]
        for i in set(r[place < 0].tolist()):
            mine = slice(ends[i] - int(count[i]), ends[i])
            out[i] = self._packed(words[i], zip(place[mine].tolist(), a[mine].tolist(), strict=True))
        return out

    def _packed(self, word: str, found: Iterable[tuple[int, int]]) -> bytes:
        """The ids of a word's segments (place and start); a character without a piece gives its bytes' or the unknown piece."""
        ids: list[int] = []
        for place, at in found:
            if place >= 0:
                ids.append(self.ids[place])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in word[at].encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return np.array(ids, np.int32).tobytes()

    def heap_merges(self, word: str) -> list[tuple[int, int]]:
        """As ``merges`` for one word, in n log n steps: the best pair is on top of a heap, the segments are a linked list."""
        table, places = self.table, self.place_of
        n, longest, scores = len(word), table.longest, table.scores
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def push(i: int, j: int) -> None:
            stop = end[j]
            if stop - i <= longest:
                place = places.get(word[i:stop])
                if place is not None:
                    heap.append((-scores[place], i, stop)) if filling else heapq.heappush(heap, (-scores[place], i, stop))

        filling = True
        for i in range(n - 1):
            push(i, i + 1)
        heapq.heapify(heap)
        filling = False
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            # A pair is stale if its left segment is gone or either has grown.
            if end[i] < 0 or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        out, i = [], 0
        while i < n:
            out.append((places.get(word[i : end[i]], -1), i))
            i = after[i]
        return out

    def _learn(self, words: Iterable[str]) -> None:
        if len(self.fresh) >= KEPT:
            self.stale, self.fresh = self.fresh, {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            if not length:
                self.fresh[""] = b""
                continue
            # A matrix of bounded size: long words advance in small groups.
            step = max(1, 400_000 // (length * (length if length < 64 else 64)))
            for i in range(0, len(same), step):
                group = same[i : i + step]
                kept = self.fresh if length <= LONG else self.passing
                kept.update(zip(group, self._segment(group, length), strict=True))

    def _segment(self, words: list[str], length: int) -> list[bytes]:
        if self.algorithm == UNIGRAM:
            return [self._packed(w, found) for w, found in zip(words, self.viterbi(words, length), strict=True)]
        if length <= LONG:
            return self.merges(words, length)
        return [self._packed(w, self.heap_merges(w)) for w in words]

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return self.units.findall(SPACE + text.replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def encode_batch(self, texts: list[str | None]) -> list[bytes | None]:
        """The int32 ids of each text as bytes."""
        cut = [None if t is None else self._words(t) for t in texts]
        out: list[bytes | None] = []
        for words in cut:
            if words is None:
                out.append(None)
                continue
            try:
                out.append(b"".join([self.fresh[w] for w in words]))
            except KeyError:
                wanted = {w for w in words if w not in self.fresh}
                old = {w: self.stale[w] for w in wanted if w in self.stale}
                self.fresh.update(old)
                out.append(words)  # type: ignore[arg-type]  # looked up below
                self._wanted |= wanted - old.keys()
        if self._wanted:
            self._learn(self._wanted)
            self._wanted = set()
        for i, words in enumerate(out):
            if isinstance(words, list):
                try:
                    out[i] = b"".join([self.fresh[w] for w in words])
                except KeyError:
                    out[i] = b"".join([self._known(w) for w in words])
        self.passing = {}
        return out

    _wanted: set[str] = set()

    def _known(self, word: str) -> bytes:
        found = self.fresh.get(word)
        if found is None:
            found = self.stale.get(word)
        if found is None:
            found = self.passing.get(word)
        if found is None:
            self._learn([word])
            found = self.fresh[word] if len(word) <= LONG else self.passing[word]
        return found

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of rows of ids: row ``i`` has ``ids[offsets[i]:offsets[i + 1]]``."""
        if self._pool is None:
            parts = [x or b"" for x in self.bytes_of]
            sizes = np.array([len(x) for x in parts], np.int64)
            self._pool = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes
        pool, starts, sizes = self._pool
        out: list[str] = []
        first = 0
        while first < len(offsets) - 1:
            # Some rows at a time: about 130,000 ids, or one longer row.
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 17), "right")) - 1)
            part = ids[offsets[first] : offsets[last]]
            size = sizes[part]
            ends = np.concatenate([[0], np.cumsum(size)])
            data = pool[np.repeat(starts[part] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
            cuts = ends[offsets[first : last + 1] - offsets[first]].tolist()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
            out += [t[1:] if t[:1] == " " else t for t in texts]
            first = last
        return out

    _pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join([x for x in map(self.bytes_of.__getitem__, ids) if x]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def model_kind(model: bytes) -> str:
    """The type in the trainer's part of a serialized model: 1 is unigram (also if unset), 2 is BPE."""
    for field, value in _fields(model):
        if field == 2:
            kind = next((v for f, v in _fields(value) if f == 3), 1)
            if kind not in (1, 2):
                raise ValueError(f"model type {kind} has no kernel")
            return UNIGRAM if kind == 1 else BPE
    return UNIGRAM


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Top-level fields of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError("not a model file")


_CODECS: dict[tuple[str, str | None], PieceCodec] = {}


def _codec(path: str, algorithm: str | None = None) -> PieceCodec:
    key = (path, algorithm)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec.load(path, algorithm)
    return _CODECS[key]


def _lists(found: list[bytes | None]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) // 4 for x in found])]).astype(np.int32)
    values = np.frombuffer(b"".join([x for x in found if x]), np.int32)
    null = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=pa.list_(pa.int32()), mask=null)


def _decoded(codec: PieceCodec, ids: pa.ListArray) -> pa.Array:
    found = codec.decode_batch(ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64))
    return pa.array([t if known else None for t, known in zip(found, ids.is_valid().to_pylist(), strict=True)], pa.string())


def encode(text: Column, path: str, algorithm: str | None = None) -> Column:
    """The piece ids of each text, for the model file at ``path`` on every worker."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, algorithm)
        for batch in batches:
            yield _lists(codec.encode_batch(batch.to_pylist()))

    return ids(text)


def round_trip(documents: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_pieces``, ``ids`` of each text, and ``decoded_md5``: the MD5 of the text that they give back.

    One pass through one worker, which holds one codec; texts don't come back,
    and of the decoded ones only the digests do.  A null text has null ids and
    digest, and 0 pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            *kept, texts = batch.columns
            ids = _lists(codec.encode_batch(texts.to_pylist()))
            digest = [None if t is None else md5(t.encode()).hexdigest() for t in _decoded(codec, ids).to_pylist()]
            count = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*kept, count, ids, pa.array(digest, pa.string())], names=[*keep, "n_pieces", "ids", "decoded_md5"])

    kinds = [(f.name, f.dataType) for c in keep for f in [documents.schema[c]]]
    schema = StructType([StructField(n, t) for n, t in [*kinds, ("n_pieces", LongType()), ("ids", ArrayType(IntegerType())), ("decoded_md5", StringType())]])
    # The text goes last, under a name of its own.
    return documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of piece ids; null for a null array."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path)
        for batch in batches:
            yield _decoded(codec, batch)

    return texts(ids)
