"""Small tables over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables up to this size are dealt out; larger ones have parts of their own.
SMALL_BYTES = 512 << 20


def spread(table: DataFrame) -> DataFrame:
    """``table`` as it is, or dealt over all tasks if it is small and lies in fewer files than there are tasks.

    A file of one row group is read by one task, whatever it costs to work on
    its rows.  Rows and results are the same; a large table is never shuffled.
    """
    tasks = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(tasks) if size <= SMALL_BYTES and len(table.inputFiles()) < tasks else table
