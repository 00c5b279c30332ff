"""Batches of texts that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from assonance.plans.batches import at_most, bounded_batches

#: Rows of an Arrow batch: texts may be very long, so few go to a worker at once.
ROWS = 400


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """As ``bounded_batches``, and at most ``rows`` rows."""
    bounded_batches(spark)
    at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)
