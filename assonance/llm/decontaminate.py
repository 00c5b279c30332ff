"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame functions only.

Words are runs of ASCII letters and digits or of anything beyond ASCII, after
A-Z are lower-cased.  A window is ``window`` consecutive words of an item; an
item of fewer words, but not none, is one shorter window.

A training text is scanned in two steps.  Every occurrence of a window of
``w`` words spans one of the ``ceil(w/2)``-word blocks that start at every
``w + 1 - ceil(w/2)``-th word of the text, so only those blocks are hashed and
probed against the set of all such grams of all windows.  Texts with a block
in the set (few, in clean corpora) are scanned at every word; window hashes
meet the windows, and a hit counts only if the words are equal.

The set is one constant of the plan, and its size, over windows of all
lengths together, is known before: up to ``SET_LIMIT`` hashes as a table of
buckets, up to ``BLOOM_LIMIT`` as a Bloom filter of ``BLOOM_BITS`` bits each,
which lets through one block in a thousand more.  For a larger benchmark it is
the hashes of the blocks that become rows, and meet the grams in a join; texts
don't.  Which items hold a window is a table of its own, whose rows are met
once for each text and window, however often the window occurs in either.

Null or wordless texts have no words and no hits; repeated rows are judged
each for itself; very long texts are scanned whole, in steps that grow with
their words; items without id hit words but can't be named; an empty
benchmark hits nothing; an empty table gives no rows; further columns are
carried along whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.functions.text import bind
from assonance.plans.durable import durable
from assonance.plans.joins import bounded_join

WINDOW = 13
#: Hashes that are put into the plan as a table, and as a Bloom filter of so many bits and probes a hash.
SET_LIMIT, BLOOM_LIMIT = 200_000, 4_000_000
BLOOM_BITS, BLOOM_PROBES = 20, 4
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs in a text whose A-Z are still there.
WORD_AS_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def _starts(n: Column, length: Column | int, step: int = 1) -> Column:
    """1, 1+step, ... of the slices of ``length`` in ``n`` words."""
    last = n - length + 1
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (``number``, ``length``, ``words``, ``hash``), and which items hold them (``number``, ``item``)."""
    tokens = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w"))
    tokens = tokens.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    at = tokens.select("item", "length", "w", F.explode(_starts(F.size("w"), F.col("length"))).alias("at"))
    cut = at.select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("words"))
    windows = cut.select("length", "words").distinct().withColumn("hash", F.xxhash64("words"))
    windows = durable(windows.withColumn("number", F.monotonically_increasing_id()))
    held = cut.where(F.col("item").isNotNull()).withColumn("hash", F.xxhash64("words")).join(windows, ["length", "hash", "words"])
    return windows, durable(held.select("number", "item").distinct())


def _block(length: int) -> tuple[int, int]:
    """Words in a probed block, and the step between blocks, such that every window spans a block."""
    gram = (length + 1) // 2
    return gram, length + 1 - gram


def _bloom_places(h: Column, bits: int) -> list[Column]:
    """Bits that stand for a hash."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(BLOOM_PROBES)]


class _Known:
    """A test whether a hash may be one of a set, which is one constant however often it is asked."""

    def __init__(self, hashes: DataFrame, set_limit: int, bloom_limit: int) -> None:
        """``hashes``: one column, distinct.  Beyond ``bloom_limit`` there is no test."""
        n = hashes.count()
        self.fits = n <= max(set_limit, bloom_limit)
        self.exact = n <= set_limit
        if not self.fits:
            return
        if self.exact:
            self.size = max(n, 1)
            buckets: list[list[str]] = [[] for _ in range(self.size)]
            for r in hashes.collect():
                buckets[r[0] % self.size].append(str(r[0]))
            told, kind = "[" + ",".join(f"[{','.join(b)}]" for b in buckets) + "]", "array<array<bigint>>"
        else:
            self.size = 64 * -(-n * BLOOM_BITS // 64)
            set_ = hashes.select(F.explode(F.array(*_bloom_places(F.col(hashes.columns[0]), self.size))).alias("bit"))
            of_word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int")))
            filled = {r[0]: r[1] for r in set_.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(of_word).collect()}
            told, kind = "[" + ",".join(str(filled.get(i, 0)) for i in range(self.size // 64)) + "]", "array<bigint>"
        # The optimizer reads the text once, and the plan has the arrays.
        self.table = F.from_json(F.lit(told), kind)

    def holds(self, table: Column, h: Column) -> Column:
        """Whether ``h`` may be in; ``table`` is ``self.table``, bound around all that asks."""
        if self.exact:
            return F.array_contains(F.get(table, F.pmod(h, F.lit(self.size)).cast("int")), h)
        out = F.lit(True)
        for bit in _bloom_places(h, self.size):
            word = F.get(table, F.floor(bit / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


class _Scan:
    """The windows of one benchmark, and the columns that find them in a text's words."""

    def __init__(self, benchmark: DataFrame, item: str, item_text: str, window: int, set_limit: int, bloom_limit: int) -> None:
        self.table, self.holders = benchmark_windows(benchmark, item, item_text, window)
        size = F.sum(F.length(F.array_join("words", " ")))
        per_length = self.table.groupBy("length").agg(F.count("*"), size).collect()
        self.lengths = sorted(r[0] for r in per_length)
        self.n_windows, self.n_bytes = sum(r[1] for r in per_length), sum(r[2] for r in per_length)
        self.n_holders, holder_bytes = self.holders.agg(F.count("*"), F.sum(F.length("item") + 8)).first()
        self.holder_bytes = holder_bytes or 0
        grams = None
        for length in self.lengths:
            gram, _ = _block(length)
            inside = F.transform(_starts(F.lit(length), gram), lambda i: F.xxhash64(F.slice("words", i, gram)))  # noqa: B023
            here = self.table.where(F.col("length") == length).select(F.lit(length).alias("length"), F.explode(inside).alias("gram"))
            grams = here if grams is None else grams.union(here)
        self.grams = None if grams is None else durable(grams.distinct())
        if grams is None:
            self.in_plan = True
            return
        self.may_block = _Known(self.grams.select("gram").distinct(), set_limit, bloom_limit)
        self.may_window = _Known(self.table.select("hash").distinct(), set_limit, bloom_limit)
        self.in_plan = self.may_block.fits and self.may_window.fits

    def blocks(self, w: Column, length: int) -> Column:
        """Hashes of the blocks of a text of which every window of ``length`` words spans one."""
        gram, step = _block(length)
        return F.transform(_starts(F.size(w), gram, step), lambda i: F.xxhash64(F.slice(w, i, gram)))

    def possible(self, w: Column) -> Column:
        """Whether some window may occur: true for every text in which one does."""

        def some(table: Column) -> Column:
            out = F.lit(False)
            for length in self.lengths:
                gram, step = _block(length)
                out = out | F.exists(_starts(F.size(w), gram, step), lambda i: self.may_block.holds(table, F.xxhash64(F.slice(w, i, gram))))  # noqa: B023
            return out

        return bind(self.may_block.table, some) if self.lengths else F.lit(False)

    def probes(self, w: Column) -> Column:
        """Places and words of what may be a window."""

        def all_(table: Column | None) -> Column:
            found = []
            for length in self.lengths:
                at = _starts(F.size(w), length)
                if table is not None:
                    at = F.filter(at, lambda i: self.may_window.holds(table, F.xxhash64(F.slice(w, i, length))))  # noqa: B023
                found.append(F.transform(at, lambda i: F.struct(i.alias("at"), F.slice(w, i, length).alias("here"))))  # noqa: B023
            return F.concat(*found)

        if not self.lengths:
            return F.array().cast(_PROBES)
        return bind(self.may_window.table, all_) if self.may_window.fits else all_(None)

    def marked(self, rows: DataFrame, text: Column) -> DataFrame:
        """``rows`` (``id`` and others) with ``may``: whether some window may occur in ``text``."""
        if self.in_plan:
            return rows.withColumn("may", bind(words(text), self.possible))
        each = None
        for length in self.lengths:
            here = rows.select("id", F.lit(length).alias("length"), F.explode(bind(words(text), lambda w: self.blocks(w, length))).alias("gram"))  # noqa: B023
            each = here if each is None else each.union(here)
        met = durable(each.join(self.grams.hint("shuffle_hash"), ["length", "gram"], "left_semi").select("id").distinct())
        return bounded_join(rows, met.withColumn("may", F.lit(True)), ["id"], "left", met.count()).withColumn("may", F.coalesce("may", F.lit(False)))

    def verified(self, rows: DataFrame) -> DataFrame:
        """``id``, ``spans`` and ``items`` of those of ``rows`` (``id``, ``probes``) that some window truly hits."""
        each = rows.select("id", F.explode("probes").alias("p"))
        each = each.select("id", "p.at", "p.here", F.size("p.here").alias("length"), F.xxhash64("p.here").alias("hash"))
        met = bounded_join(each, self.table, ["length", "hash"], "inner", self.n_windows, spread=F.xxhash64("id", "at"), right_bytes=self.n_bytes)
        met = durable(met.where(F.col("here") == F.col("words")).select("id", "at", "length", "number"))
        spans = met.groupBy("id").agg(_merged(F.collect_list(F.struct("at", (F.col("at") + F.col("length")).alias("end")))).alias("spans"))
        # A text and an item meet in one row before any list is made.
        named = bounded_join(met.select("id", "number").distinct(), self.holders, ["number"], "inner", self.n_holders, spread=F.xxhash64("id"), right_bytes=self.holder_bytes)
        items = named.select("id", "item").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
        return spans.join(items, "id", "left").select("id", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


_PROBES = "array<struct<at:int,here:array<string>>>"
_SPANS = "array<struct<start:int,end:int>>"


def _scanned(rows: DataFrame, text: Column, scan: _Scan) -> DataFrame:
    """``id`` and ``row`` with the words of ``text`` counted and probed."""
    none = F.array().cast(_PROBES)
    if scan.in_plan:
        look = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(scan.possible(w), scan.probes(w)).otherwise(none).alias("probes"))
    else:
        rows = scan.marked(rows, text)
        look = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.col("may"), scan.probes(w)).otherwise(none).alias("probes"))
    return rows.select("id", "row", bind(words(text), look).alias("x")).select("id", "row", "x.n_words", "x.probes")


def find_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    set_limit: int = SET_LIMIT,
    bloom_limit: int = BLOOM_LIMIT,
) -> DataFrame:
    """Columns ``row`` (the columns ``keep`` of the document as a struct), ``n_words``, ``spans`` and ``items``.

    ``spans`` are the sorted, disjoint word ranges [start, end) that some
    window covers, counted from 0; ``items`` the sorted ids of the items met.
    By default all columns but the text are kept.  What is kept is stored
    once; only rows in which something was found are shuffled.
    """
    scan = _Scan(benchmark, item, item_text, window, set_limit, bloom_limit)
    keep = [c for c in documents.columns if c != text] if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = _numbered(documents.select(row.alias("row"), F.col(f"`{text}`").alias("body")), scan)
    looked = durable(_scanned(rows, F.col("body"), scan))
    none = looked.where(F.size("probes") == 0).select("row", "n_words", F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    some = looked.where(F.size("probes") > 0)
    met = some.select("id", "row", "n_words").join(scan.verified(some), "id", "left")
    return none.union(met.select("row", "n_words", F.coalesce("spans", F.array().cast(_SPANS)), F.coalesce("items", F.array().cast("array<string>"))))


def _numbered(rows: DataFrame, scan: _Scan) -> DataFrame:
    """``rows`` with an ``id``; stored first where they are read more than once, since the numbers depend on the reading."""
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    return numbered if scan.in_plan else durable(numbered)


def _merged(hits: Column) -> Column:
    """Word ranges of overlapping or touching hits as one, from 0: the runs of the places that hits cover."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"] - 1, h["end"] - 2)))))

    def runs(p: Column) -> Column:
        first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1))
        last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.cast("int").alias("start"), (b + 1).cast("int").alias("end")))

    return bind(covered, runs)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def contaminated(spans: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are benchmark words."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= n_words)


def _judged(
    documents: DataFrame, benchmark: DataFrame, text: str, item: str = "item_id", item_text: str = "text", window: int = WINDOW,
    set_limit: int = SET_LIMIT, bloom_limit: int = BLOOM_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """``row`` of the texts that can't hold a window, and ``row``, ``n_words``, ``spans`` of those that a window hits.

    Only what may hold one is stored once and then shuffled.
    """
    scan = _Scan(benchmark, item, item_text, window, set_limit, bloom_limit)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = scan.marked(_numbered(documents.select(row), scan), F.col(f"row.`{text}`"))
    held = durable(rows.where("may").select("row", F.monotonically_increasing_id().alias("id")))
    looked = held.select("id", bind(words(F.col(f"row.`{text}`")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), scan.probes(w).alias("probes"))).alias("x"))
    looked = durable(looked.select("id", "x.n_words", "x.probes").where(F.size("probes") > 0))
    hit = looked.select("id", "n_words").join(scan.verified(looked), "id").select("id", "n_words", "spans")
    return rows.where(~F.col("may")).select("row"), held.join(hit, "id", "left")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    clean, judged = _judged(documents, benchmark, text, **options)
    gone = F.coalesce(contaminated(F.col("spans"), F.col("n_words")), F.lit(False))
    return clean.union(judged.where(~gone).select("row")).select("row.*")


def cut_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents with their columns; the words of hit spans, and what stands between those, are cut from the text."""
    clean, judged = _judged(documents, benchmark, text, **options)
    body = F.col(f"row.`{text}`")
    # One flag per word: what the spans cover, as runs beside each other.
    end_before = lambda i: F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)
    runs = F.transform("spans", lambda s, i: F.concat(F.array_repeat(F.lit(False), s["start"] - end_before(i)), F.array_repeat(F.lit(True), s["end"] - s["start"])))
    rest = F.array_repeat(F.lit(False), (F.col("n_words") - F.element_at("spans", -1)["end"]).cast("int"))
    # gaps[i] stands before word i; the last one ends the text.
    parts = F.struct(
        F.split(F.translate(body, UPPER, LOWER), WORD).alias("gaps"), F.regexp_extract_all(body, F.lit(WORD_AS_WRITTEN), F.lit(0)).alias("words"), F.concat(F.flatten(runs), rest).alias("hit")
    )

    def joined(d: Column) -> Column:
        after_hit = lambda i: F.coalesce(F.get(d["hit"], i - 1), F.lit(False))
        word = lambda i: F.when(F.get(d["hit"], i), F.lit("")).otherwise(F.get(d["words"], i))
        gap = lambda g, i: F.when(F.coalesce(F.get(d["hit"], i), F.lit(False)) & after_hit(i), F.lit("")).otherwise(g)
        return F.array_join(F.transform(d["gaps"], lambda g, i: F.concat(gap(g, i), F.coalesce(word(i), F.lit("")))), "")

    cut = judged.withColumn("cut", F.when(F.size("spans") > 0, bind(parts, joined)).otherwise(body))
    whole = cut.select(*[(F.col("cut") if c == text else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
    return clean.select("row.*").union(whole)
