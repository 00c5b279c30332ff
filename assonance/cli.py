"""Command line: find text reuse by sound in files."""

from __future__ import annotations

import argparse
import logging
import os
import shlex
import shutil
import subprocess
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from assonance import __version__
from assonance.operators.matches import Filters
from assonance.operators.reuse import ReuseConfig, find_reuse
from assonance.sources.corpus import loader
from assonance.sources.sinks import group_lines, output_format, terminal_lines, write, write_groups
from assonance.sources.tables import read_sound_table, table_sounds


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("assonance", description="Find text reuse between documents by how it sounds.", allow_abbrev=False)
    p.add_argument("paths", nargs="+", metavar="path")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-v", "--verbose", action="count", default=0, help="log to stderr; twice for more")
    p.add_argument("-i", "--input-format", default="txt", help="txt (a file is a document) or jsonl (a line is)")
    p.add_argument("-o", "--output-file", help="folder to write; its suffix jsonl, csv or html is the format")
    p.add_argument("-s", "--sound-table", required=True, help="JSON file of readings")
    p.add_argument("-n", "--ngram-order", type=int, default=4)
    p.add_argument("-k", "--threshold", type=float, default=0.7)
    p.add_argument("-l", "--len-limit", type=int, default=50)
    p.add_argument("-c", "--context", type=int, default=4)
    p.add_argument("-a", "--all", action="store_true", help="also matches without a graphic variant")
    p.add_argument("--min-length", type=int, default=8)
    p.add_argument("--max-length", type=int, default=64)
    p.add_argument("--min-graphic-similarity", type=float, default=0.0)
    p.add_argument("--max-graphic-similarity", type=float, default=0.9)
    p.add_argument("--min-phonetic-similarity", type=float, default=0.7)
    p.add_argument("--max-phonetic-similarity", type=float, default=1.0)
    p.add_argument("-g", "--group", action="store_true", help="group matches that share spans")
    return p


def _show(lines: Iterator[str], out) -> None:
    """Through the pager (``PAGER``, else less) on a terminal, and plainly otherwise."""
    pager = shlex.split(os.environ.get("PAGER") or "less")
    if out is not None or not sys.stdout.isatty() or not shutil.which(pager[0]):
        (out or sys.stdout).writelines(line + "\n" for line in lines)
        return
    with subprocess.Popen(pager, stdin=subprocess.PIPE, text=True) as shown:
        try:
            shown.stdin.writelines(line + "\n" for line in lines)
        except BrokenPipeError:
            # The reader has seen enough.
            pass


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    given = parser().parse_args(args)
    logging.basicConfig(stream=sys.stderr, level=[logging.WARNING, logging.INFO, logging.DEBUG][min(given.verbose, 2)])
    if given.output_file:
        output_format(given.output_file)
    spark = spark or SparkSession.builder.appName("assonance").getOrCreate()
    filters = Filters(
        given.min_length, given.max_length, given.min_graphic_similarity, given.max_graphic_similarity,
        given.min_phonetic_similarity, given.max_phonetic_similarity,
    )
    config = ReuseConfig(given.ngram_order, given.threshold, given.len_limit, given.context, given.all, filters)
    sounds = table_sounds(read_sound_table(spark, given.sound_table))
    frame = find_reuse(loader(given.input_format)(spark, given.paths), sounds, config)
    if given.group:
        found = frame.grouped()
        if given.output_file:
            write_groups(frame.docs, found, given.output_file, gap_sign=config.gap_sign)
        else:
            _show(group_lines(frame.docs, found, gap_sign=config.gap_sign), out)
    elif given.output_file:
        write(frame.docs, frame.matches, given.output_file, config.context, config.gap_sign)
    else:
        _show(terminal_lines(frame.docs, frame.matches, config.context, config.gap_sign), out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
