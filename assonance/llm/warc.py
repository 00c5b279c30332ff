"""WARC archives: writing, and normalising whole-file gzip to one member per record.

``write_archives`` writes each partition as archives of one gzip stream each,
as many tools do, which can't be read at a record.  ``normalise_archives``
inflates such a stream once, from front to back, writes every record as a
gzip member of its own, and beside the archive an index of the members'
offsets and lengths.  ``read_archives`` reads records back by that index.

Files go through pyarrow's file systems to the folder that is given, which is
qualified as Spark understands it (``fs.defaultFS``); each is
written under a name of its attempt and then renamed, so a task that runs
again leaves the same files.  Memory: one record and two stream buffers.

Pages with equal payloads (also empty ones) of at least ``least`` bytes: the
one with the smallest id is a response and the others are revisits of it.
Null payloads are empty; a row whose id repeats the smallest one is a response
too; rows without id are revisits if their payload has a response, else
responses; ids and URLs may hold any signs; very long payloads are one record;
an empty table makes no archive; further columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assonance.llm.batches import small_batches
from assonance.plans.durable import durable, shared_dir
from assonance.plans.joins import bounded_join

ROLL_BYTES = 64 << 20
BUFFER = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path; one without a scheme means another place to Spark than to this process, and raises."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        raise ValueError(f"a path without scheme: {path}")
    local = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and authority by which Hadoop (and so Spark) finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _urn(page: str | None) -> str:
    """The record id of a page; signs that would end a header are written as in URLs."""
    return "<urn:nopage>" if page is None else f"<urn:page:{_line(page.replace('%', '%25'))}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; that of a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def split_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and all bytes of each record of a gzip file of one or many members, inflated once."""
    inflate, held = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal inflate
        data = inflate.unconsumed_tail or (inflate.unused_data if inflate.eof else b"") or source.read(BUFFER)
        if not data:
            return False
        if inflate.eof:
            inflate = zlib.decompressobj(31)
        held.extend(inflate.decompress(data, BUFFER * 4))
        return True

    while True:
        end = -1
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head = _headers(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(held[:size])
        del held[:size]


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO) -> int:
    """Rewrite one archive record by record; the number of records."""
    offset = n = 0
    for head, data in split_records(source):
        packed = _member(data)
        target.write(packed)
        index.write((json.dumps({"offset": offset, "length": len(packed), "id": head.get("warc-record-id")}) + "\n").encode())
        offset += len(packed)
        n += 1
    return n


def _named(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return unquote(found[1], errors="replace") if found else None


def parsed(data: bytes) -> dict:
    """What one record says: page, type, payload length and digest, and the payload of a response."""
    end = data.index(b"\r\n\r\n") + 4
    head = _headers(data[: end - 4])
    block = data[end : end + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n") + 4
    http, payload = _headers(block[: http_end - 4]), block[http_end:]
    told = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (_digest(payload) != told or len(payload) != int(http["content-length"])):
        raise ValueError(f"record {head['warc-record-id']} isn't what its digest says")
    return {
        "page": _named(head["warc-record-id"]), "payload_bytes": int(http["content-length"]), "payload_digest": told,
        "record_type": head["warc-type"], "refers_to": _named(head.get("warc-refers-to")), "payload": payload,
    }


def _open_new(files: pafs.FileSystem, path: str) -> tuple[str, BinaryIO]:
    mine = f"{path}.{uuid.uuid4().hex}.part"
    return mine, files.open_output_stream(mine, compression=None)


def planned(pages: DataFrame, id: str, url: str, html: str, least: int = 0) -> DataFrame:
    """``page``, ``url``, ``payload`` and ``refers_to`` (the page whose record a revisit names), as strings and bytes."""
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    same = durable(same.where(F.col("n") > 1).select("sha", "first"))
    known = bounded_join(rows, same, ["sha"], "left", same.count(), spread=F.xxhash64("id", "url"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return known.select(F.col("id").cast("string").alias("page"), "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``planned`` records; one row per archive: ``archive`` and ``n``."""
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        part, number, open_now = TaskContext.get().partitionId(), 0, None

        def close() -> pa.RecordBatch:
            nonlocal open_now, number
            mine, stream, packer, _, n = open_now
            stream.write(packer.flush())
            stream.close()
            name = f"pages-{part:06d}-{number:04d}.warc.gz"
            files.move(mine, f"{base}/{name}")
            open_now, number = None, number + 1
            return pa.RecordBatch.from_pydict({"archive": [name], "n": pa.array([n], pa.int64())})

        for batch in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_now is None:
                    mine, stream = _open_new(files, f"{base}/pages-{part:06d}-{number:04d}")
                    open_now = [mine, stream, zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0]
                data = record(page, url, payload, refers_to)
                open_now[1].write(open_now[2].compress(data))
                open_now[3] += len(data)
                open_now[4] += 1
                if open_now[3] >= roll:
                    yield close()
        if open_now is not None:
            yield close()

    return durable(records.select("page", "url", "payload", "refers_to").mapInArrow(run, "archive string, n long"))


def normalise_archives(archives: DataFrame, folder: str, remove: bool = True) -> DataFrame:
    """For each of ``archives``, a normalised one and its index: ``archive``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = name.removesuffix(".warc.gz") + ".members.warc.gz"
                # A task that runs again finds its source gone if it had ended before.
                if files.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    with files.open_input_stream(f"{base}/{new}.idx", compression=None) as done:
                        n = done.read().count(b"\n")
                else:
                    mine, target = _open_new(files, f"{base}/{new}")
                    side, index = _open_new(files, f"{base}/{new}.idx")
                    with files.open_input_stream(f"{base}/{name}", compression=None) as source, target, index:
                        n = normalise(source, target, index)
                    files.move(mine, f"{base}/{new}")
                    files.move(side, f"{base}/{new}.idx")
                    if remove:
                        files.delete_file(f"{base}/{name}")
                yield pa.RecordBatch.from_pydict({"archive": [new], "n": pa.array([n], pa.int64())})

    count = max(1, min(archives.count(), 100_000))
    return durable(archives.select("archive").repartition(count, "archive").mapInArrow(run, "archive string, n long"))


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the normalised ``archives``, each read at the offset its index gives."""
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}.idx", compression=None) as side:
                    index = [json.loads(x) for x in side.read().splitlines()]
                with files.open_input_file(f"{base}/{name}") as source:
                    for at in range(0, len(index), 200):
                        rows = [parsed(zlib.decompress(source.read_at(x["length"], x["offset"]), 31)) for x in index[at : at + 200]]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=False)], names=names)

    schema = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    count = max(1, min(archives.count(), 100_000))
    return archives.select("archive").repartition(count, "archive").mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own beside the checkpoints, which all executors share."""
    folder = f"{qualified(spark, shared_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    return folder


def remove_folder(folder: str) -> None:
    files, base = file_system(folder)
    if files.get_file_info(base).type != pafs.FileType.NotFound:
        files.delete_dir(base)
