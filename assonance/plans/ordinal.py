"""Global row numbers without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assonance.plans.durable import durable


def with_ordinal(df: DataFrame, name: str, *order: Column, weight: Column | None = None) -> DataFrame:
    """``df`` with ``name``, the place of each row in ``order`` from 0; ``order`` must be total.

    With ``weight``, the sum of the weights of the rows before it.  Rows are
    range-partitioned; a partition numbers its own rows and adds what the
    partitions before it have (one number each for the driver).
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    window = Window.partitionBy("__part").orderBy(*order)
    if weight is None:
        inside = F.row_number().over(window) - 1
    else:
        inside = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight
    offset = F.element_at(F.expr(f"array({', '.join(f'{b}L' for b in before) or '0L'})"), F.col("__part") + 1)
    return ranged.withColumn(name, offset + inside).drop("__part")
