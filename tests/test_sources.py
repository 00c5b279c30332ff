"""Loaders, tables, sinks, markup, command line and streams."""

import io
import json
import logging
import re

import pytest

from assonance.sources.corpus import JsonLinesLoader
from pyspark.sql import functions as F

from assonance import cli
from assonance.functions import markup
from assonance.functions.sounds import LATIN
from assonance.sources import corpus as C
from assonance.sources import sinks, tables
from assonance.streaming.incremental import stream_seeds

READINGS = {c: [["0", "1", "2", s, "4", "5", "", "", "book", "page"], ["no"]] for c, s in zip("abcdefghijAB", "abcdefghijab", strict=True)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("texts")
    (top / "one.txt").write_text("xx。abcdefghij。\nyy", encoding="utf-8")
    (top / "two words.txt").write_text("ABcdefghij", encoding="utf-8")
    (top / "notes.md").write_text("no")
    (top / "t.jsonl").write_text('{"id": "b", "text": "q □", "year": 3}\n\n{"id": "a", "text": "longer text"}\n', encoding="utf-8")
    (top / "bad.jsonl").write_text('{"id": "b"}\n')
    (top / "sounds.json").write_text(json.dumps(READINGS))
    (top / "m.tsv").write_text("\ta\tb\na\t10\t-3\nb\t-3\t10\n")
    return top


def test_plain_text(spark, folder, caplog):
    with caplog.at_level(logging.WARNING, "assonance"):
        rows = C.PlaintextLoader()(spark, [f"{folder}/one*", f"{folder}/*.txt", f"{folder}/notes.md"]).collect()
    assert {r["id"]: r["text"] for r in rows} == {"one": "xx。abcdefghij。yy", "two words": "ABcdefghij"}
    assert all(r["size"] == (folder / f"{r['id']}.txt").stat().st_size for r in rows)
    assert "notes.md" in caplog.text
    with pytest.raises(C.NoFilesError):
        C.PlaintextLoader()(spark, [f"{folder}/nothing*"])


def test_json_lines(spark, folder):
    rows = C.loader("jsonl")(spark, [f"{folder}/t.jsonl"]).orderBy("place").collect()
    assert [(r["id"], r["text"], r["meta"], r["size"]) for r in rows] == [("b", "q 〼", {"year": "3"}, 0), ("a", "longer text", {}, 0)]
    with pytest.raises(Exception, match="no id or no text"):
        C.loader("jsonl")(spark, [f"{folder}/bad.jsonl"]).collect()
    assert isinstance(C.loader("anything"), C.PlaintextLoader)


def test_tables(spark, folder):
    table = tables.read_sound_table(spark, f"{folder}/sounds.json")
    assert table.where("grapheme = 'A'").first()["segments"] == ["0", "1", "2", "a", "4", "5", "", ""]
    sounds = tables.table_sounds(table)
    assert spark.range(1).select(sounds.token_phonemes(F.lit("A"))).first()[0] == ["a", "", ""]
    assert tables.scorer(tables.read_similarities(spark, f"{folder}/m.tsv")) == {("a", "a"): 10.0, ("a", "b"): -3.0, ("b", "a"): -3.0, ("b", "b"): 10.0}


def test_markup():
    variants = lambda a, b: {a, b} == {"a", "A"}
    marked = markup.mark(list("ax-cd。"), list("Ay b-，".replace(" ", "q")), "-", variants)
    assert marked == "[variant]a[/variant][mismatch]x[/mismatch][mismatch]c[/mismatch][insertion]d[/insertion]。"
    assert markup.mark(list("ab"), list("a"), "-", variants) == "ab"
    assert markup.with_context("m", "l", "", 2) == "[context]　l[/context]m[context]　　[/context]"
    assert markup.with_context("m", "l", "r", 0) == "m"
    assert markup.context_bounds(1, 3, 4, 2) == ((1, 1), (3, 4)) and markup.context_bounds(2, 3, 9, 2) == ((0, 2), (3, 5))
    assert markup.to_html("<[variant]a[/variant]") == '&lt;<span style="color:blue">a</span>'
    assert markup.to_terminal("[mismatch]a[/mismatch]", True) == "\x1b[31ma\x1b[0m" and markup.to_terminal("[mismatch]a[/mismatch]", False) == "a"
    with pytest.raises(ValueError):
        markup.with_context("", "", "", -1)


def run(spark, folder, *more):
    out = io.StringIO()
    assert cli.main([f"{folder}/*.txt", "-s", f"{folder}/sounds.json", "-n", "3", "--min-length", "5", *more], spark, out) == 0
    return out.getvalue()


def test_command_line(spark, folder, tmp_path, monkeypatch):
    monkeypatch.delenv("LESS", raising=False)
    lines = run(spark, folder).splitlines()
    assert lines[0].split("\t")[:2] == ["one", "3-12"] and "abcdefghij" in lines[0] and lines[1].startswith("two words\t0-9\t")
    assert run(spark, folder, "--group").splitlines()[0].startswith("two words\t0–9\tABcdefghij")
    run(spark, folder, "-o", f"{tmp_path}/r.jsonl")
    told = [json.loads(x) for x in "".join(p.read_text() for p in sorted((tmp_path / "r.jsonl").glob("part-*"))).splitlines()]
    assert [(t["u_id"], t["v_text"], t["graphic_similarity"]) for t in told] == [("one", "ABcdefghij", 0.8)]
    run(spark, folder, "-o", f"{tmp_path}/r.csv", "--max-graphic-similarity", "0.1")
    assert any("u_id,v_id" in p.read_text() for p in (tmp_path / "r.csv").glob("part-*"))
    run(spark, folder, "-o", f"{tmp_path}/r.html")
    page = "".join(p.read_text() for p in (tmp_path / "r.html").glob("part-*"))
    assert '<span style="color:blue">A</span>' in page and "opacity:.5" in page
    run(spark, folder, "-g", "-o", f"{tmp_path}/g.jsonl")
    assert "anchor_text" in "".join(p.read_text() for p in (tmp_path / "g.jsonl").glob("part-*"))


def test_command_line_is_checked_first(spark, folder, capsys):
    with pytest.raises(ValueError, match="no output format"):
        run(spark, folder, "-o", "result")
    for flag in ("--help", "--version"):
        with pytest.raises(SystemExit) as done:
            cli.main([flag])
        assert done.value.code == 0
    assert sinks.output_format("a/b.csv") == ".csv"


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("1", 0, "abcd efgh"), ("2", 1, "zabcd"), ("3", 2, "efghi abcd")]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], "doc_id string, doc_ord long, text string").coalesce(1).write.json(f"{source}/{n}")
    stream = spark.readStream.schema("doc_id string, doc_ord long, text string").option("maxFilesPerTrigger", 1).json(f"{source}/*")
    query = stream_seeds(stream, LATIN, 4, f"{tmp_path}/index", f"{tmp_path}/seeds", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {frozenset((r["u_id"], r["v_id"])) for r in spark.read.parquet(f"{tmp_path}/seeds").collect()}
    assert got == {frozenset("12"), frozenset("13"), frozenset("23")}


def test_batches_of_a_stream(spark, tmp_path):
    """Ids known from before count as they did, a batch may run again, u has the lower ordinal, and look-ups read few buckets."""
    from assonance.streaming.incremental import BUCKETS, _met, _placed, _stored, index_batch

    batches = [[("1", 5, "abcd efgh"), ("1", 6, "later row")], [("2", 1, "zabcd"), ("1", 0, "efgh efgh")], [("3", 9, "efghi abcd")], []]
    for n in (0, 1, 1, 2, 3):
        index_batch(spark.createDataFrame(batches[n], "doc_id string, doc_ord long, text string"), n, LATIN, 4, f"{tmp_path}/i", f"{tmp_path}/s")
    seeds = {(r["u_id"], r["v_id"], r["u_ord"], r["v_ord"], r["u_start"], r["v_start"]) for r in spark.read.parquet(f"{tmp_path}/s").collect()}
    assert seeds == {("2", "1", 1, 5, 1, 0), ("2", "3", 1, 9, 1, 5), ("1", "3", 5, 9, 0, 5), ("1", "3", 5, 9, 4, 0)}
    stored = _stored(spark, f"{tmp_path}/i/values", 9)
    met = _met(stored, _placed(spark.createDataFrame([("nothing",)], "key string"), "key"), "key")
    assert met.count() == 0 and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN|INSET)", met._jdf.queryExecution().toString()) and 1 < stored.select("bucket").distinct().count() < BUCKETS


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    """Documents keep the order of paths, also of paths with odd signs."""
    for folder, id in (("b +x", "1"), ("a", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.jsonl").write_text("\n".join(json.dumps({"id": f"{id}{k}", "text": "t"}) for k in "xyz"))
    got = JsonLinesLoader()(spark, [f"{tmp_path}/b +x/*.jsonl", f"{tmp_path}/a/*.jsonl"]).orderBy("place").collect()
    assert [r["id"] for r in got] == ["1x", "1y", "1z", "2x", "2y", "2z"]
