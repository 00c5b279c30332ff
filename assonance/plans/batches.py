"""Sizes of the Arrow batches that go to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

BYTES = 16 << 20


def at_most(spark: SparkSession, name: str, most: int) -> None:
    """Lower a session setting to ``most``; what is lower already (and above 0) stays.

    Plans are lazy, so what is set stays for the session: it is only ever made
    smaller, and no operator depends on larger batches.
    """
    known = int(spark.conf.get(name).removesuffix("b"))
    if known <= 0 or known > most:
        spark.conf.set(name, str(most))


def bounded_batches(spark: SparkSession, size: int = BYTES) -> None:
    """Arrow batches of about ``size`` bytes at most, whatever rows they hold."""
    at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)
