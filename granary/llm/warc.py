"""Dictionary-compressed WARC archives: each record is a Zstandard frame of its own, and the archive starts with a
skippable frame that holds the dictionary they were compressed with, so an archive can be read without any other file.

Records of equal payload are stored once: the one with the smallest id is a response, the others are revisits of it.
Archives are written by the executors through pyarrow's file systems, each attempt under a name of its own; only those in
the committed manifest are read, so a lost executor or a repeated task leaves no trace in the result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm._shared import materialize, new_path

MAGIC = 0x184D2A5D  # the skippable frame that carries a dictionary
MIN_REVISIT = 100  # bytes of payload from which equal ones are stored once
SAMPLE_BYTES = 4 << 20  # records an archive's dictionary is built from: its first ones, up to so many bytes
DICT_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20  # compressed bytes after which an archive is closed and another begun
LEVEL = 3
BROADCAST_ARCHIVES = 100_000  # names up to which the manifest is broadcast (under 5 MB); beyond, it is joined by shuffle


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    name = "null" if page_id is None else page_id
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{digest}')}>",
        f"WARC-Target-URI: {(url or '').translate({13: None, 10: None})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {name}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, rest[:n]


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or none where there are too few records to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # records that have nothing in common
        return b""


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(content)) + content


def archive_frames(records: Iterator[bytes], level: int = LEVEL) -> Iterator[tuple[int, bytes]]:
    """(records in it, bytes) of each part of an archive: the dictionary's frame, then one frame for each record. Takes no
    more records once ARCHIVE_BYTES are reached, and leaves none that it took unwritten."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    trained = dictionary(held)
    yield 0, skippable(trained)
    to = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True)
    size = 0
    for r in held:
        frame = to.compress(r)
        size += len(frame)
        yield 1, frame
    held = []
    while size < ARCHIVE_BYTES and (r := next(records, None)) is not None:
        frame = to.compress(r)
        size += len(frame)
        yield 1, frame


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive."""
    view = memoryview(data)
    magic, n = struct.unpack_from("<II", view)
    if magic != MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    trained, at = bytes(view[8 : 8 + n]), 8 + n
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    while at < len(view):
        frame = d.decompressobj()
        out, end = [], at
        while not frame.eof:
            step = view[end : end + (1 << 16)]
            if not len(step):
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(step))
            end += len(step)
        at = end - len(frame.unused_data)
        yield parse(b"".join(out))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        taken = written = 0

        def records() -> Iterator[bytes]:
            nonlocal taken
            for b in batches:
                for page_id, url, payload, digest, kind, refers_to in zip(*(b.column(i) for i in range(6)), strict=True):
                    taken += 1
                    yield record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), kind.as_py(), refers_to.as_py())

        source = records()
        while (first := next(source, None)) is not None:
            name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as to:
                for k, frame in archive_frames(chain([first], source)):  # chain leaves source open for the next archive
                    to.write(frame)
                    n, size = n + k, size + len(frame)
            written += n
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})
        rows = taken + sum(b.num_rows for b in batches)
        if written != rows:
            raise ValueError(f"{written} records of {rows} rows were written")

    return run


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to) of each row. The groups' smallest ids are found on narrow rows; only
    digests that repeat are joined back."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = base.filter(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").select(F.col("digest").alias("same"), "first_id")
    met = base.join(again, (F.col("digest") == F.col("same")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write pages as archives into folder; returns the committed manifest (archive, records, bytes).

    A null payload is empty; a null id is written as "null" and never is what others refer to unless nothing else could
    be (then all stay responses). Rows that repeat the smallest id of a payload are all responses. An empty table writes
    no archive."""
    return materialize(decided(pages, **columns).mapInArrow(_writer(folder), "archive string, records long, bytes long"), "warc-manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []

                def batch(rows):
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

                for head, body in read_archive(content.as_py()):
                    whole, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                    if kind == "response" and hashlib.sha256(body).hexdigest() != whole:
                        raise ValueError(f"record {head['WARC-Record-ID']} doesn't match its digest")
                    ids = [None if v in (None, "null") else int(v) for v in (head["X-Page-Id"], head.get("X-Refers-To-Page-Id"))]
                    rows.append((ids[0], head["WARC-Target-URI"], int(head["X-Payload-Bytes"]), whole, kind, ids[1], body if payloads and kind == "response" else None))
                    if len(rows) >= 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that the manifest names: READ's columns; a revisit has no payload of its own."""
    archives = manifest.count()
    if not archives:
        return spark.createDataFrame([], READ)
    names = manifest.select("archive")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(names) if archives <= BROADCAST_ARCHIVES else names, "archive", "left_semi")
    return named.select("content").mapInArrow(_reader(payloads), READ)


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back, each payload verified against its digest."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    if ":" not in folder.split("/")[0]:
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    manifest = write_archives(pages, folder, **columns)
    return read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
