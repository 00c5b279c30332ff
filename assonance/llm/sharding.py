"""Sharding by sampled splitters, in DataFrame functions only.

Size-weighted key samples give quantile boundaries; the boundaries cut the
records into many small ranges; ranges that came out overfull are cut again
from a sample of their own.  Each range is then summed exactly, and one pass
of prefix sums inside the ranges turns the cut points into exact ones: shard
``s`` takes the records whose middle byte lies in the ``s``-th part of all
bytes, in key order.  So sizes of shards differ by less than two records
however the sample fell.  The sample only decides how evenly tasks are loaded.

Defined results: a null key sorts first; records with equal keys are told
apart by their place in the input, so a single key that holds a third of all
rows is cut like any other; a null text weighs 1; an empty table gives no
rows; further columns are carried along whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assonance.plans.durable import durable

#: Ranges: for small tables about one per 100 records, for large ones one per two million, within these bounds.
FEWEST_RANGES, USUAL_RANGES, MOST_RANGES = 32, 512, 4096
SAMPLES_PER_RANGE = 24
OVERFULL = 2.0
ROUNDS = 4


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, str):
        return f"CAST(unhex('{value.encode().hex()}') AS {kind})"
    return f"CAST('{value}' AS {kind})"


def _boundary_array(bounds: list[tuple], key_type) -> str:
    """SQL text of an array that the optimizer folds into one constant."""
    kind = key_type.simpleString()
    made = (f"named_struct('has', {str(h).lower()}, 'key', {_literal(k, kind)}, 'at', {at}L)" for h, k, at in bounds)
    return f"array({', '.join(made)})"


def _range_of(place: Column, bounds: list[tuple], key_type) -> Column:
    """How many boundaries lie at or below ``place``, found in two steps of about a square root each."""
    if not bounds:
        return F.lit(0)
    step = max(2, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda b: b <= place))
    coarse = below(F.expr(_boundary_array([b[0] for b in blocks], key_type)))
    every = F.expr(f"array({', '.join(_boundary_array(b, key_type) for b in blocks)})")
    fine = F.element_at(every, F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(fine)).cast("int")


def _weighted_quantiles(sample: list, want: int, per_boundary: float) -> list[tuple]:
    """Boundaries after every ``per_boundary`` units of sample weight, keys ascending."""
    ordered = sorted(((r["has"], r["key"], r["at"]), r["weight"]) for r in sample)
    bounds, held = [], 0.0
    for place, weight in ordered:
        held += weight
        if held >= per_boundary and len(bounds) < want:
            bounds.append(place)
            held = 0.0
    return bounds


def shard_by_bytes(
    records: DataFrame,
    key: str,
    size: Column,
    shards: int = 8,
    ranges: int | None = None,
    samples_per_range: int = SAMPLES_PER_RANGE,
) -> DataFrame:
    """Columns ``row`` (all columns of ``records`` as a struct), ``shard`` and ``slot``.

    ``ranges`` bounds what reaches the driver: that many boundaries and sums,
    and about ``ranges * samples_per_range`` sampled keys.
    """
    key_type = records.schema[key].dataType
    base = durable(
        records.select(
            F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("row"),
            F.struct(
                F.col(f"`{key}`").isNotNull().alias("has"),
                F.col(f"`{key}`").alias("key"),
                F.monotonically_increasing_id().alias("at"),
            ).alias("place"),
            size.alias("bytes"),
        )
    )
    total, n_rows = base.agg(F.sum("bytes"), F.count("*")).first()
    if not total:
        return base.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = ranges or min(MOST_RANGES, max(FEWEST_RANGES, min(USUAL_RANGES, n_rows // 100), n_rows // 2_000_000))
    unit = F.pmod(F.xxhash64("place.at", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    want = ranges * samples_per_range

    def draw(rows: DataFrame, share: float) -> list:
        """Each record with the odds its bytes give; one larger than a draw counts as often as it would be drawn."""
        odds = F.col("bytes") * F.lit(share)
        return rows.where(unit < odds).select("place.has", "place.key", "place.at", F.greatest(odds, F.lit(1.0)).alias("weight")).collect()

    bounds = _weighted_quantiles(draw(base, want / total), ranges - 1, samples_per_range)
    target = total / ranges
    for left in range(ROUNDS, -1, -1):
        cut = base.select("row", "place", "bytes", _range_of(F.col("place"), bounds, key_type).alias("range"))
        sums = {r["range"]: (r["bytes"], r["rows"]) for r in cut.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).collect()}
        overfull = sorted(r for r, (b, n) in sums.items() if b > OVERFULL * target and n > 1)
        if not left or not overfull or len(bounds) > 2 * ranges:
            break
        inside = cut.where(F.col("range").isin(overfull))
        more = _weighted_quantiles(draw(inside, want / total * 4), ranges, 2 * samples_per_range)
        added = sorted({*bounds, *more})
        if len(added) == len(bounds):
            break
        bounds = added

    bytes_before, rows_before, b, n = [], [], 0, 0
    for r in range(len(bounds) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + sums.get(r, (0, 0))[0], n + sums.get(r, (0, 0))[1]
    at = lambda values: F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), F.col("range") + 1)
    in_range = Window.partitionBy("range").orderBy("place")
    up_to = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = durable(
        cut.withColumn("end", at(bytes_before) + F.sum("bytes").over(up_to))
        .withColumn("ordinal", at(rows_before) + F.row_number().over(in_range) - 1)
        .withColumn("shard", F.floor((2 * F.col("end") - F.col("bytes")) * shards / (2 * total)).cast("int"))
        .select("row", "ordinal", F.least("shard", F.lit(shards - 1)).alias("shard"))
    )
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("ordinal").alias("first")).collect()}
    starts = F.element_at(F.lit([first.get(s, 0) for s in range(shards)]).cast("array<bigint>"), F.col("shard") + 1)
    return placed.select("row", "shard", (F.col("ordinal") - starts).alias("slot"))
