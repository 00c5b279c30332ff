"""Removing the lines that a site repeats, in DataFrame functions only.

Pages are grouped by host.  For each host and line, the pages that contain
the line are divided by all pages of the host; lines over ``max_ratio`` on at
least ``min_pages`` pages are boilerplate and are cut from every page of that
host.  A page counts once for a line however often it repeats it.  Lines of
several words seldom recur by chance: ``phrase_ratio`` is a bound of their own.

Lines are compared without surrounding blanks, by the 128-bit MD5 of their
text.  Blank lines are neither counted nor cut.  Null hosts form a host of
their own; null texts stay null and count as pages; repeated rows are pages
of their own; an empty table gives no rows; further columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assonance.plans.durable import durable
from assonance.plans.joins import bounded_join

MAX_RATIO = 0.1
MIN_PAGES = 5
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate_lines(
    pages: DataFrame,
    host: str,
    text: str,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    phrase_ratio: float | None = None,
    distinct: bool = False,
) -> DataFrame:
    """``host``, ``digest``, ``pages`` and ``ratio`` of every line over the ratio; lines of several words have ``phrase_ratio``, if given.

    With ``distinct``, pages of a host with equal texts (by MD5) count as one.
    """
    keyed = pages.select(_host(host).alias("host"), F.col(f"`{text}`").alias("text"))
    whole = [F.coalesce(_digest(F.col("text")), F.lit(b"")).alias("whole")] if distinct else []
    number = F.count_distinct("whole") if distinct else F.count("*")
    totals = durable(keyed.select("host", *whole).groupBy("host").agg(number.alias("host_pages")))
    lines = F.array_distinct(F.transform(_lines(F.col("text")), lambda x: _bare(x)))
    seen = (
        keyed.select("host", *whole, F.explode(F.filter(lines, lambda x: x != "")).alias("line"))
        .groupBy("host", _digest(F.col("line")).alias("digest"))
        .agg(number.alias("pages"), F.bool_or(F.col("line").rlike(r"\S\s+\S")).alias("phrase"))
        .where(F.col("pages") >= min_pages)
    )
    least = F.when(F.col("phrase"), max_ratio if phrase_ratio is None else phrase_ratio).otherwise(max_ratio)
    return (
        bounded_join(seen, totals, ["host"], "inner", totals.count())
        .withColumn("ratio", F.col("pages") / F.col("host_pages"))
        .where(F.col("ratio") > least)
        .drop("phrase")
    )


def _host(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\u0000"))


def drop_site_lines(
    pages: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    whole_over: float | None = None,
    phrase_ratio: float | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Columns ``row`` (the page as a struct), ``text``, ``n_lines`` and ``n_dropped``.

    ``n_lines`` counts the lines that aren't blank.  With ``whole_over``, a
    page that would lose more than that share of the characters of its lines
    is left whole, whether or not another page has its text.
    """
    heavy = durable(boilerplate_lines(pages, host, text, max_ratio, min_pages, phrase_ratio, distinct).select("host", "digest"))
    n_heavy = heavy.count()
    by_host = heavy.groupBy("host").agg(F.collect_set("digest").alias("heavy"))
    keyed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), _host(host).alias("host"))
    joined = bounded_join(keyed, by_host, ["host"], "left", n_heavy)
    none = F.array().cast("array<binary>")
    split = joined.select(
        "row",
        F.transform(
            _lines(F.col(f"row.`{text}`")),
            lambda x: F.struct(
                x.alias("line"),
                (_bare(x) != "").alias("full"),
                F.array_contains(F.coalesce("heavy", none), _digest(_bare(x))).alias("cut"),
            ),
        ).alias("lines"),
    )
    size = lambda c: F.aggregate(F.col("lines"), F.lit(0), lambda n, x: n + F.when(c(x), F.length(x["line"])).otherwise(0))
    goes = lambda x: x["full"] & x["cut"]
    if whole_over is not None:
        spared = size(goes) > F.lit(whole_over) * size(lambda x: x["full"])
        split = split.withColumn("spared", F.coalesce(spared, F.lit(False)))
        goes = lambda x: x["full"] & x["cut"] & ~F.col("spared")
    left = F.filter("lines", lambda x: ~goes(x))
    return split.select(
        "row",
        F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias("text"),
        F.coalesce(F.size(F.filter("lines", lambda x: x["full"])), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("lines", goes)), F.lit(0)).cast("long").alias("n_dropped"),
    )
