"""A quality classifier: a factorisation machine over hashed words and structure.

Features of a whole text: its words hashed into ``WORD_SLOTS`` (logarithm of
the count, at length one), statistics of its structure (shares of upper case,
digits, signs, single signs, blanks; word lengths, distinct and repeated
words), standardised and also in quantile bins, and its length.  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),

linear in the number of features.  Labels, language, source and id are never
features.

The machine is fitted on at most ``SAMPLE`` labelled texts (a documented
bound: those of the smallest hash of their id; of an id with several rows the
text of the smallest hash); their features, not their texts, go to the driver.  Everything is scored, whole
texts however long.  Null texts score as empty ones; repeated documents are
scored each for itself; repeated labels of an id count as their mean; without
labels of both kinds every score is the share of ones (a half without any
label, and the model says ``fitted`` False); an empty table gives no rows;
only the named columns are read, so further ones may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.llm.batches import small_batches

WORD_SLOTS = 1024
BINS = 8
RANK = 6
SAMPLE = 8_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4
KEPT = 100_000
#: Words whose hashes are kept are no longer than this.
SHORT = 64
#: The signs whose share each is a statistic of its own.
SIGNS = b"!|#$%&*.,-_?:;/\\()<>{}[]=+@\"'"
N_STATS = 14 + len(SIGNS)


class _Slots(dict):
    """64-bit word hashes, kept for the latest words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


_HASHES = _Slots()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Word slots (at length one, or zero) and raw statistics."""
    raw = (text or "").encode("utf-8", "replace")
    size = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    words = raw.lower().split()
    n = len(words)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    slots = np.log1p(np.bincount((h % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS)).astype(np.float32)
    slots /= max(float(np.linalg.norm(slots)), 1e-9)
    kinds, counts = np.unique(h, return_counts=True)
    again = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    upper, lower, digit = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    signs = seen[33:127].sum() - upper - lower - digit
    top = counts.max() / n if n else 0.0
    stats = [
        np.log1p(size), np.log1p(n), size / max(n, 1), upper, lower, digit, signs, seen[128:].sum(), seen[10], seen[32],
        len(kinds) / max(n, 1), top, again, upper / max(upper + lower, 1e-9),
    ]
    return slots, np.concatenate([np.array(stats), seen[list(SIGNS)]]).astype(np.float32)


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    #: Whether there were labels of both kinds to learn from.
    fitted: bool = False

    def design(self, slots: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Word slots, standardised statistics and their bins side by side."""
        plain = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        bins = (stats[:, :, None] > self.edges[None, :, :]).sum(axis=2)
        one_hot = np.eye(BINS, dtype=np.float32)[bins].reshape(len(stats), -1) * np.float32(0.5)
        return np.concatenate([slots, plain.astype(np.float32), one_hot], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * (s * s - (x * x) @ (self.v * self.v)).sum(axis=1)

    def probability(self, slots: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.design(slots, stats)).astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, slots: np.ndarray, stats: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorisationMachine:
        n_stats = stats.shape[1]
        p = WORD_SLOTS + n_stats * (1 + BINS)
        share = float(y.mean()) if len(y) else 0.5
        rng = np.random.default_rng(seed)
        model = cls(
            stats.mean(axis=0) if len(y) else np.zeros(n_stats, np.float32),
            stats.std(axis=0) + 1e-6 if len(y) else np.ones(n_stats, np.float32),
            np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32) if len(y) else np.zeros((n_stats, BINS - 1), np.float32),
            float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3))),
            np.zeros(p, np.float32),
            np.zeros((p, RANK), np.float32),
        )
        if not len(y) or share in (0.0, 1.0):
            return model
        model.fitted = True
        model.v = rng.normal(0, 0.02, (p, RANK)).astype(np.float32)
        x = model.design(slots, stats)
        moments = [[np.zeros_like(a), np.zeros_like(a)] for a in (model.w, model.v)] + [[0.0, 0.0]]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
            for at in range(0, len(y), BATCH):
                rows = x[order[at : at + BATCH]]
                s = rows @ model.v
                out = model.w0 + rows @ model.w + 0.5 * (s * s - (rows * rows) @ (model.v * model.v)).sum(axis=1)
                g = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[order[at : at + BATCH]]) / len(rows)).astype(np.float32)
                grads = [
                    rows.T @ g + DECAY * model.w,
                    rows.T @ (g[:, None] * s) - model.v * ((rows * rows).T @ g)[:, None] + DECAY * model.v,
                    float(g.sum()),
                ]
                step += 1
                for i, (value, grad) in enumerate(zip([model.w, model.v, model.w0], grads, strict=True)):
                    m, q = moments[i]
                    m, q = 0.9 * m + 0.1 * grad, 0.999 * q + 0.001 * grad * grad
                    moments[i] = [m, q]
                    moved = value - rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
                    if i == 0:
                        model.w = moved
                    elif i == 1:
                        model.v = moved
                    else:
                        model.w0 = float(moved)
        return model


def _features_of(rows: DataFrame) -> DataFrame:
    """``y``, and the features as bytes, of ``y`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype(np.float16).tobytes() for a, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())],
                names=["y", "slots", "stats"],
            )

    return rows.mapInArrow(run, "y double, slots binary, stats binary")


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def train(
    documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> FactorisationMachine:
    """Fitted on up to ``sample`` labelled texts that aren't held out."""
    small_batches(documents.sparkSession)
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # The chosen labels are at most ``sample`` rows of two numbers.
    texts = documents.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id")
    # One text of an id, however often its rows are repeated: what is collected has ``sample`` rows at most.
    one = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    got = _features_of(one.select("y", "first.text")).collect()
    got.sort(key=lambda r: (bytes(r["stats"]), bytes(r["slots"]), r["y"]))
    slots = np.frombuffer(b"".join(bytes(r["slots"]) for r in got), np.float16).reshape(-1, WORD_SLOTS).astype(np.float32)
    stats = np.frombuffer(b"".join(bytes(r["stats"]) for r in got), np.float32).reshape(len(got), N_STATS)
    return FactorisationMachine.fit(slots, stats, np.array([r["y"] for r in got]))


def score(text: Column, model: FactorisationMachine) -> Column:
    """The probability of label 1 of each whole text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [features(t) for t in batch.to_pylist()]
            if not found:
                yield pa.array([], pa.float64())
                continue
            yield pa.array(model.probability(np.stack([a for a, _ in found]), np.stack([b for _, b in found])), pa.float64())

    return scored(text)
