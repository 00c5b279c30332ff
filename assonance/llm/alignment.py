"""How the tokens of two tokenizers lie over each other, and how often which of them meet.

A text is cut before each single space between two characters that aren't
blank: both tokenizers always cut there, so what is between two such places (a
stretch) has the same tokens wherever it stands.  A task takes its texts in
blocks of bounded size.  The stretches of a block that the worker hasn't met
lately are tokenized and laid end to end, and their bytes marked where a token
of either side ends: between two neighbouring marks lies one link, at a mark of
both sides ends a group.  What a stretch links and how its groups read is kept,
so a stretch is aligned once however often it stands in the blocks of a worker.
Each block gives its documents and one partial count for each pair of ids.
Spark adds these up over the corpus, finds the highest count of each A id, and
gives each block back the counts of its own pairs, by which its documents are
measured.

A text counts only if the bytes of its A tokens and of its B tokens are both a
space and the text; other texts, null and empty ones have no tokens.  A
stretch that isn't rendered by its own tokens makes its text one stretch, so
that it's the whole text that decides.  Very long texts are read whole (one
without single spaces is one stretch); repeated rows count each for itself; an
empty table gives no rows; further columns stay inside ``row`` and may have
any names.  Memory: a block of ``BLOCK`` bytes (or one longer text), and
``KEPT`` stretches with their links.
"""

from __future__ import annotations

import gc
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assonance.llm.batches import small_batches
from assonance.llm.token_counts import PATTERN
from assonance.plans.durable import durable, shared_dir

#: Bytes of the texts of a block.
BLOCK = 3 << 20
#: Stretches that are kept, their most characters, and their characters on average.
KEPT, SHORT, MEAN = 400_000, 48, 20
#: Stretches that are aligned at once.
AT_ONCE = 100_000
SPACE = "▁"
#: A place at which both tokenizers cut: a single space between characters that aren't blank.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside another blank or at an end: there ``split`` would cut too often.
MIXED = re.compile(r" (?:(?<!\S )|(?!\S))")
#: Longer stretches go to the file's own library.
LONG = 10_000
#: Characters of shorter ones that go to the tokenizer at once.
JOINED = 8_000

_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_STORED = "block long, place int, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pair array<int>, times array<int>, pair_a array<int>, pair_b array<int>, pair_n array<int>"


class Tokenizer:
    """One tokenizer: ids of stretches (each a text after a space), and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str], list[bytes]], tuple[np.ndarray, np.ndarray]], bytes_of: dict[int, bytes], lossless: bool = False) -> None:
        """``encode``: from stretches and their bytes all ids in a row, and how many each stretch has.

        ``lossless``: the ids of a text always spell it, as where every byte has a token and tokens are only ever joined.
        """
        self.encode, self.lossless = encode, lossless
        spelt = [bytes_of.get(i, b"") for i in range(max(bytes_of, default=0) + 1)]
        self.size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.start = np.cumsum(self.size) - self.size
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def rendered(self, ids: np.ndarray, sizes: np.ndarray, wholes: list[bytes]) -> np.ndarray:
        """Whether the ids of each stretch spell it."""
        if self.lossless:
            return np.ones(len(sizes), bool)
        given = np.fromiter(map(len, wholes), np.int64, len(wholes))
        fine = _sums(self.size[ids], sizes) == given
        ids = ids[np.repeat(fine, sizes)]
        told = self.spelt[_ranges(self.start[ids], self.size[ids])]
        wrong = np.flatnonzero(told != np.frombuffer(b"".join(compress(wholes, fine)), np.uint8))
        fine[np.flatnonzero(fine)[np.searchsorted(np.cumsum(given[fine]), wrong, "right")]] = False
        return fine


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts of so many values."""
    total, ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many of each, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


def _printable() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file; what its special tokens spell is plain text."""
    import tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre = model["pre_tokenizer"] or {}
    if model["model"]["type"] != "BPE" or model["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    lib = tokenizers.Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    lib.no_truncation()
    lib.no_padding()
    byte = _printable()
    bytes_of = {i: bytes([byte[c] for c in t]) if all(c in byte for c in t) else t.encode() for t, i in lib.get_vocab(with_added_tokens=True).items()}
    lossless = set(bytes_of.values()) >= {bytes([x]) for x in range(256)}
    whole = lambda x: lib.encode(" " + x, add_special_tokens=False).ids
    vocabulary, last, ranked = model["model"]["vocab"], -1, lossless
    for merge in model["model"]["merges"]:
        now = vocabulary["".join(merge.split(" ") if isinstance(merge, str) else merge)]
        ranked, last = ranked and now >= last, now
    if not ranked:
        return Tokenizer(lambda stretches, _: _listed([whole(x) for x in stretches]), bytes_of, lossless)
    # Ids in the order of merges are ranks, by which tiktoken merges the same pairs, at less cost for a call.
    import tiktoken

    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes_of[i]: i for i in vocabulary.values() if len(bytes_of[i]) == 1 or i not in special(model)}, special_tokens={})
    size = np.array([len(bytes_of.get(i, b"")) for i in range(max(bytes_of) + 1)], np.int64)

    def encode(stretches: list[str], wholes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        told = [np.empty(0, np.int32)]
        for text, long in _joined(stretches):
            told.append(np.array(whole(text) if long else fast.encode_ordinary(" " + text), np.int32))
        ids = np.concatenate(told)
        ends = np.cumsum(np.fromiter(map(len, wholes), np.int64, len(wholes)))
        return ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends), prepend=-1)

    return Tokenizer(encode, bytes_of, lossless)


def _joined(stretches: list[str]) -> Iterator[tuple[str, bool]]:
    """Stretches in their order, many in one text where they are cut apart again (no blank at an end); and whether it is one long stretch."""
    run, size = [], 0
    for x in stretches:
        alone = not x or len(x) >= LONG or x[0].isspace() or x[-1].isspace()
        if run and (alone or size >= JOINED):
            yield " ".join(run), False
            run, size = [], 0
        if alone:
            yield x, len(x) >= LONG
        else:
            run.append(x)
            size += len(x) + 1
    if run:
        yield " ".join(run), False


def special(model: dict) -> set[int]:
    return {t["id"] for t in model["added_tokens"]}


def pieces(path: str) -> Tokenizer:
    """A SentencePiece file that puts a space before a text and has no piece over a cut."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
    if any(SPACE in n.lstrip(SPACE) for n in names):
        raise ValueError(f"a piece reaches over a space: {path}")
    if not lib.encode("a", out_type=str)[0].startswith(SPACE):
        raise ValueError(f"no space is put before a text: {path}")
    bytes_of = {i: bytes([int(n[3:5], 16)]) if lib.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)}
    # The space before a stretch is put there by the model itself.
    return Tokenizer(lambda stretches, _: _listed(lib.encode(stretches, num_threads=1) if stretches else []), bytes_of)


def stretches_of(text: str) -> list[str]:
    """The parts of a text, without the space before each."""
    return CUT.split(text) if MIXED.search(text) else text.split(" ")


class _Numbers(dict[str, int]):
    """Numbers stretches as they are asked for; ``new`` are those that weren't known."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, stretch: str) -> int:
        self[stretch] = n = len(self)
        self.new.append(stretch)
        return n


class Blocks:
    """Makes the rows of blocks of texts, and keeps what it knows of stretches."""

    def __init__(self, a: Tokenizer, b: Tokenizer) -> None:
        self.a, self.b = a, b
        self.width = len(b.size)
        #: Ids with what stands before them: nothing, a comma, a bar or a semicolon.
        self.most = max(len(a.size), len(b.size))
        self.names = pa.array([f"{sign}{i}" for sign in ("", ",", "|", ";") for i in range(self.most)])
        self._forget()

    def _forget(self) -> None:
        self.number, self.characters = _Numbers(), 0
        #: Of each stretch: its groups as text, whether its ids render it, tokens, groups, and where its links begin.
        self.told: list[str | None] = []
        self.fine, self.n_a, self.n_b, self.n_groups, self.n_links, self.first = np.empty(0, bool), *(np.empty(0, np.int64) for _ in range(5))
        #: Of each link: its pair.  Of each pair: its ids as one number; the same in order, and the pairs in that order.
        self.pair, self.pairs, self.sorted, self.order = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, stretches: Iterable[str], n: int) -> np.ndarray:
        """The numbers of n stretches, of which those not known are learned."""
        places = np.fromiter(map(self.number.__getitem__, stretches), np.int32, n)
        new, self.number.new = self.number.new, []
        for i in range(0, len(new), AT_ONCE):
            self._learn(new[i : i + AT_ONCE])
        return places

    def _learn(self, new: list[str]) -> None:
        wholes = [b" " + x.encode() for x in new]
        (ids_a, sizes_a), (ids_b, sizes_b) = self.a.encode(new, wholes), self.b.encode(new, wholes)
        fine = self.a.rendered(ids_a, sizes_a, wholes) & self.b.rendered(ids_b, sizes_b, wholes)
        ids_a, ids_b = ids_a[np.repeat(fine, sizes_a)], ids_b[np.repeat(fine, sizes_b)]
        sizes_a, sizes_b = sizes_a * fine, sizes_b * fine
        size = np.fromiter(map(len, wholes), np.int64, len(wholes)) * fine
        # Every byte of the stretches laid end to end: bit 0 where an A token ends, bit 1 where a B token ends.
        ends = np.zeros(int(size.sum()), np.uint8)
        ends[np.cumsum(self.a.size[ids_a]) - 1] = 1
        ends[np.cumsum(self.b.size[ids_b]) - 1] |= 2
        at = np.flatnonzero(ends)
        ends = ends[at]
        of_a, of_b, both = (ends & 1).astype(bool), ends > 1, ends == 3
        done_a, done_b, done = (np.cumsum(x) for x in (of_a, of_b, both))
        # A link ends where either token does; its tokens are the first of their sides not to end before.
        codes = ids_a[done_a - of_a].astype(np.int64) * self.width + ids_b[done_b - of_b]
        links = np.diff(np.searchsorted(at, np.cumsum(size)), prepend=0)
        told = self._told((ids_a, ids_b), (sizes_a, sizes_b), (done - both)[of_a], (done - both)[of_b], done_a[both], done_b[both])
        self._keep(told, fine, sizes_a, sizes_b, _sums(both, links), links, codes)
        self.characters += sum(map(len, new))

    def _told(self, ids: tuple[np.ndarray, ...], sizes: tuple[np.ndarray, ...], group_a: np.ndarray, group_b: np.ndarray, done_a: np.ndarray, done_b: np.ndarray) -> list[str]:
        """The groups of each stretch as text, from the group of each token and the tokens of each side up to the end of each group."""
        names = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        leads = np.diff(group_a, prepend=-1) > 0
        before = np.where(leads, 3, 1)
        before[(np.cumsum(sizes[0]) - sizes[0])[sizes[0] > 0]] = 0
        # In a group its A tokens come first: after the B tokens of all groups before, and before its own B tokens.
        names[np.arange(len(group_a)) + np.concatenate([[0], done_b])[group_a]] = before * self.most + ids[0]
        leads = np.diff(group_b, prepend=-1) > 0
        names[np.arange(len(group_b)) + done_a[group_b]] = np.where(leads, 2, 1) * self.most + ids[1]
        edges = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), self.names.take(pa.array(names))), "").to_pylist()

    def _keep(self, told: list[str], fine: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, codes: np.ndarray) -> None:
        self.told += told
        first = len(self.pair) + np.cumsum(n_links) - n_links
        for name, values in {"fine": fine, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "first": first}.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        found, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.sorted, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.sorted)
        known[inside] = self.sorted[at[inside]] == found[inside]
        pairs = np.empty(len(found), np.int32)
        pairs[known] = self.order[at[known]]
        pairs[~known] = len(self.pairs) + np.arange((~known).sum())
        self.pair = np.concatenate([self.pair, pairs[back]])
        self.pairs = np.concatenate([self.pairs, found[~known]])
        self.sorted, self.order = np.insert(self.sorted, at[~known], found[~known]), np.insert(self.order, at[~known], pairs[~known])

    def _trim(self, places: np.ndarray) -> None:
        """Where too much is kept, of that only what the latest block has, up to half of ``KEPT``."""
        if len(self.number) <= KEPT and self.characters <= KEPT * MEAN:
            return
        names, used = list(self.number), np.unique(places).tolist()
        kept = np.array([i for i in used if len(names[i]) <= SHORT][: KEPT // 2], np.int64)
        fine, n_a, n_b, n_groups, n_links = (x[kept] for x in (self.fine, self.n_a, self.n_b, self.n_groups, self.n_links))
        codes, told = self.pairs[self.pair[_ranges(self.first[kept], n_links)]], [self.told[i] for i in kept]
        self._forget()
        for i in kept:
            self.number[names[i]] = len(self.number)
        self.characters = sum(map(len, self.number))
        self._keep(told, fine, n_a, n_b, n_groups, n_links, codes)

    def rows(self, texts: list[str | None], with_groups: bool) -> dict[str, list | pa.Array]:
        """For each text its numbers and pairs; the first also has what all of them share: the pairs and how many texts hold each."""
        n = len(texts)
        cut = [stretches_of(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, n)
        places = self.find(chain.from_iterable(cut), int(sizes.sum()))
        doc = np.repeat(np.arange(n), sizes)
        lost = np.unique(doc[~self.fine[places]])
        if len(lost):
            whole = self.find([texts[i] for i in lost], len(lost))
            fine, stay = self.fine[whole], ~np.isin(doc, lost)
            doc, places = np.concatenate([doc[stay], lost[fine]]), np.concatenate([places[stay], whole[fine]])
            order = np.argsort(doc, kind="stable")
            doc, places = doc[order], places[order]
            sizes = np.bincount(doc, minlength=n)
        out: dict[str, list | pa.Array] = {c: pa.array(_sums(getattr(self, c)[places], sizes)) for c in _NUMBERS}
        ends = np.cumsum(sizes).tolist()
        told = list(map(self.told.__getitem__, places.tolist()))
        whole = [";".join(told[end - size : end]) for end, size in zip(ends, sizes.tolist(), strict=True)]
        out["groups_sha256"] = [sha256(x.encode()).hexdigest() if x else "" for x in whole]
        out["groups"] = whole if with_groups else [None] * n
        links = self.n_links[places]
        pair = self.pair[_ranges(self.first[places], links)]
        every = np.zeros(len(self.pairs), bool)
        every[pair] = True
        here = np.flatnonzero(every)
        # Each document's pairs, by the numbers that they have in this block.
        met = np.sort(np.repeat(doc, links) * len(here) + (np.cumsum(every) - 1)[pair])
        leads = np.flatnonzero(np.diff(met, prepend=-1))
        times = np.diff(leads, append=len(met))
        doc, pair = np.divmod(met[leads], max(len(here), 1))
        edges = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
        out |= {c: pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for c, x in {"pair": pair, "times": times}.items()}
        shared = dict(zip(("pair_a", "pair_b", "pair_n"), (*np.divmod(self.pairs[here], self.width), np.bincount(pair, minlength=len(here))), strict=True))
        edges = pa.array([0, *[len(here)] * n], pa.int32())
        self._trim(places)
        return out | {c: pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for c, x in shared.items()}


_KNOWN: dict[tuple[str, str], Blocks] = {}


def _blocks(a: str, b: str) -> Blocks:
    if (a, b) not in _KNOWN:
        _KNOWN[a, b] = Blocks(byte_level(a), pieces(b))
    return _KNOWN[a, b]


@dataclass(frozen=True)
class Alignment:
    """``documents``: ``row``, the numbers of each text, and its groups.  ``pair_counts``: ``a``, ``b``, ``n`` (documents that hold the pair linked) and ``best`` (the most of any pair of ``a``)."""

    documents: DataFrame
    pair_counts: DataFrame


def _write_blocks(documents: DataFrame, text: str, a: str, b: str, keep: Sequence[str], with_groups: bool, folder: str) -> DataFrame:
    """Tokenizes and aligns the texts in blocks, and stores the blocks' rows in ``folder``."""
    given = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("number")
    )
    stored = StructType([given.schema["row"], *StructType.fromDDL(_STORED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, rows, held, number, size = _blocks(a, b), [], [], None, 0
        # What a block makes has no cycles, and looking for some takes a quarter of the time.
        gc.disable()

        def block() -> pa.RecordBatch:
            # A block has the number of its first row, and so the same one if its task runs again.
            n = len(held)
            columns = {"row": pa.concat_arrays(rows), "block": [number] * n, "place": list(range(n))} | blocks.rows(held, with_groups)
            schema = pa.schema([("row", rows[0].type), *to_arrow_schema(StructType(stored.fields[1:]))])
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            texts, numbers, start = batch.column(1).to_pylist(), batch.column(2).to_pylist(), 0
            for i, told in enumerate(texts):
                if number is None:
                    number = numbers[i]
                held.append(told)
                size += len(told or "")
                if size >= BLOCK:
                    rows.append(batch.column(0).slice(start, i + 1 - start))
                    yield block()
                    rows, held, number, size, start = [], [], None, 0, i + 1
            if start < len(texts):
                rows.append(batch.column(0).slice(start))
        if held:
            yield block()

    given.mapInArrow(run, stored).write.parquet(folder)
    return documents.sparkSession.read.schema(stored).parquet(folder)


def align(documents: DataFrame, a: str, b: str, keep: Sequence[str], text: str = "text", with_groups: bool = False) -> Alignment:
    """Aligns the tokens of ``a`` (a byte-level BPE file) and ``b`` (a SentencePiece file) in each text.

    Each document has ``row`` (its columns ``keep``), ``n_a`` and ``n_b``
    (tokens), ``n_groups`` (cut where tokens of both end), ``n_links``
    (overlapping token pairs), ``n_best`` (links whose pair of ids is in as
    many documents as any of its A id), ``count_sum`` (of the pairs' documents
    over all links), ``groups_sha256`` and, if asked for, ``groups``.
    """
    spark = documents.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    try:
        docs = _write_blocks(documents, text, a, b, keep, with_groups, folder)
        part = F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("pair", "p")
        parts = docs.where(F.size("pair_a") > 0).select(F.col("block").alias("home"), part).select("home", "pair", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
        counts = durable(parts.groupBy("a", "b").agg(F.sum("n").alias("n")))
        # One row for each id of a vocabulary.
        counts = counts.join(F.broadcast(counts.groupBy("a").agg(F.max("n").alias("best"))), "a")
        # A pair has one row in a block at most, so the rows of the hottest pair are as many as blocks.
        told = parts.select("home", "pair", "a", "b").join(counts, ["a", "b"]).select("home", "pair", F.col("n").alias("count"), (F.col("n") == F.col("best")).alias("is_best"))
        left = docs.select("row", "block", *_NUMBERS, "groups", "groups_sha256", "pair", "times")
        kept = StructType([docs.schema["row"], *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long").fields])

        def measure(documents: pa.Table, pairs: pa.Table) -> pa.Table:
            count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
            at = pairs.column("pair").to_numpy()
            count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("is_best").to_numpy()
            lists = documents.column("pair").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            pair, times = lists.flatten().to_numpy(), documents.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            sums = []
            for weight in (best, count):
                total = np.concatenate([[0], np.cumsum(weight[pair] * times)])
                sums.append(pa.array(total[ends] - total[ends - sizes], pa.int64()))
            out = documents.select(["row", *_NUMBERS, "groups", "groups_sha256"])
            return out.append_column("n_best", sums[0]).append_column("count_sum", sums[1])

        done = durable(left.groupBy("block").cogroup(told.groupBy("home")).applyInArrow(measure, kept))
        return Alignment(done if with_groups else done.drop("groups"), durable(counts))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
