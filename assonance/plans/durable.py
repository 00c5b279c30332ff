"""Cutting lineage in storage that every executor can read.

Nothing here uses localCheckpoint: a lost executor must not lose rows.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where neither the setting nor the context names one, and the master
    is this machine (tests), is a folder of our own made; on a cluster a folder
    of one machine would lose rows, so that raises.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    active = context._jsc.sc().getCheckpointDir()
    if active.isEmpty():
        if not known and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = known or tempfile.mkdtemp(prefix="assonance-")
        context.setCheckpointDir(known)
        active = context._jsc.sc().getCheckpointDir()
    return known or active.get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
