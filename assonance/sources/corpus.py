"""Corpora: plain text, JSON Lines and tables, as ``id``, ``text``, ``meta``, ``size``, ``place``.

``place`` orders documents of one size: the path, or the order of the lines.
"""

from __future__ import annotations

import glob as globs
import logging
import os
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assonance.functions.text import normalise

log = logging.getLogger("assonance")


class NoFilesError(ValueError):
    """None of the paths holds a file of the wanted type."""


class CorpusLoader(Protocol):
    """Extension point: anything that turns paths into a corpus."""

    def __call__(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame: ...


def check_paths(spark: SparkSession, paths: Sequence[str], suffix: str) -> list[str]:
    """Files with the suffix among the expanded globs, each once; a warning for every other file.

    Local paths are expanded here, others by Hadoop's own glob.
    """
    found: dict[str, None] = {}
    for path in paths:
        if "://" in str(path):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(str(path))
            system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
            files = [str(s.getPath()) for s in (system.globStatus(hadoop) or []) if s.isFile()]
        else:
            files = [f for f in globs.glob(str(path)) if os.path.isfile(f)]
        for file in files:
            if os.path.splitext(file)[1] == suffix:
                found[file] = None
            else:
                log.warning("%s isn't a %s file and is passed over", file, suffix)
    if not found:
        raise NoFilesError(f"no {suffix} files in {list(paths)}")
    return list(found)


class PlaintextLoader:
    """One UTF-8 file is one document; its id is the file's name without suffix."""

    suffix = ".txt"

    def __call__(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        files = check_paths(spark, paths, self.suffix)
        rows = spark.read.text(files, wholetext=True)
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        return rows.select(
            F.regexp_replace(F.url_decode(name), r"\.txt$", "").alias("id"),
            normalise(F.col("value")).alias("text"),
            F.create_map().cast("map<string,string>").alias("meta"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_path").alias("place"),
        )


class JsonLinesLoader:
    """One object a line, with ``id`` and ``text``; what else it has becomes ``meta``.

    Documents keep the order of paths and lines, so all have size 0.
    """

    suffix = ".jsonl"

    def __call__(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        files = check_paths(spark, paths, self.suffix)
        # Whole paths, since files of one name may stand in several folders.
        whole = [f if "://" in f else f"file://{os.path.abspath(f)}" for f in files]
        order = F.array_position(F.array(*map(F.lit, whole)), F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
        lines = spark.read.text(files).where(F.trim("value") != "")
        parsed = lines.select(
            F.from_json("value", "map<string,string>").alias("o"),
            F.concat_ws(":", F.lpad(order.cast("string"), 9, "0"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("place"),
        )
        missing = F.raise_error(F.lit("a line has no id or no text"))
        need = lambda k: F.when(F.col("o")[k].isNotNull(), F.col("o")[k]).otherwise(missing.cast("string"))
        return parsed.select(
            need("id").alias("id"),
            normalise(need("text")).alias("text"),
            F.map_filter("o", lambda k, _: ~k.isin("id", "text")).alias("meta"),
            F.lit(0).cast("long").alias("size"),
            "place",
        )


class TableLoader:
    """Documents of Parquet tables: ``id_column`` and ``text_column``; the other columns become ``meta``."""

    def __init__(self, id_column: str = "doc_id", text_column: str = "text") -> None:
        self.id, self.text = id_column, text_column

    def __call__(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        return self.of(spark.read.parquet(*map(str, paths)))

    def of(self, table: DataFrame) -> DataFrame:
        id, text = F.col(f"`{self.id}`").cast("string"), F.col(f"`{self.text}`")
        pairs = [x for c in table.columns if c not in (self.id, self.text) for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        return table.select(
            id.alias("id"), normalise(F.coalesce(text, F.lit(""))).alias("text"), F.create_map(*pairs).cast("map<string,string>").alias("meta"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), F.lpad(id, 20, "0").alias("place"),
        )


def loader(input_format: str) -> CorpusLoader:
    """``jsonl`` reads JSON Lines; every other format reads plain text."""
    return JsonLinesLoader() if input_format == "jsonl" else PlaintextLoader()
