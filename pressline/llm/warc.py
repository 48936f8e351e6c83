"""WARC archives with a shared Zstandard dictionary.

Each writer task puts its records into archives of a bounded size. An archive starts with a skippable frame that holds a
dictionary built from its own first records; every record is then one Zstandard frame compressed with that dictionary, so
a record can be read alone, by its offset. Equal payloads are stored once: the others are revisit records.

Archives are written under a name of their own attempt and renamed when whole, so a task that runs again leaves one file.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pressline.llm.frames import Batches, narrow, stored
from pressline.session import work_folder

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 64 << 10
# Records a dictionary is built from: this many bytes of the first ones of an archive, and so much of each.
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD = 32 << 10
ARCHIVE_BYTES = 256 << 20
LEAST_REVISIT = 1000
LEVEL = 3


@dataclass(frozen=True)
class Record:
    """One page. ``refers_to`` is the page whose record has the payload, for a revisit."""

    page_id: int | None
    url: str
    payload_bytes: int
    digest: str
    payload: bytes
    refers_to: int | None
    is_revisit: bool

    def to_bytes(self, date: str) -> bytes:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {self.payload_bytes}\r\n\r\n".encode()
        block = http if self.is_revisit else http + self.payload
        lines = [
            ("WARC-Type", "revisit" if self.is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{_id_text(self.page_id)}>"),
            ("WARC-Date", date), ("WARC-Target-URI", " ".join(self.url.split())), ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{self.digest}"),
        ]
        if self.is_revisit:
            lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{_id_text(self.refers_to)}>")]
        lines.append(("Content-Length", str(len(block))))
        head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n"
        return head + block + b"\r\n\r\n"

    @staticmethod
    def read(stream) -> Record | None:
        """The next record of a stream of them; None at its end."""
        version = stream.readline()
        if not version:
            return None
        if version != VERSION + b"\r\n":
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        named = {}
        while (line := stream.readline()) != b"\r\n":
            key, value = line.decode("utf-8", "surrogatepass").removesuffix("\r\n").split(": ", 1)
            named[key] = value
        block = stream.read(int(named["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{named['WARC-Record-ID']} ends early")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))
        revisit, digest = named["WARC-Type"] == "revisit", named["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
            raise ValueError(f"payload of {named['WARC-Record-ID']} does not have its digest")
        refers = _id_of(named["WARC-Refers-To"]) if revisit else None
        return Record(_id_of(named["WARC-Record-ID"]), named["WARC-Target-URI"], size, digest, payload, refers, revisit)


def _id_text(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _id_of(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on records; a plain one of their bytes where there are too few to train on."""
    samples = [r[:SAMPLE_RECORD] for r in records]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Writes one archive to a stream; the first records are held back until the dictionary is built from them."""

    def __init__(self, stream, date: str):
        self.stream, self.date = stream, date
        self.held: list[bytes] = []
        self.held_bytes = self.size = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: Record) -> None:
        data = record.to_bytes(self.date)
        if self.compressor is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= SAMPLE_BYTES:
                self._start()
        else:
            self._put(data)

    def _start(self) -> None:
        made = dictionary(self.held)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(made)) + made)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(made))
        for data in self.held:
            self._put(data)
        self.held = []

    def _put(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.stream.write(frame)
        self.size += len(frame)

    def close(self) -> None:
        if self.compressor is None:
            self._start()


def read_archive(stream) -> Iterator[Record]:
    """The records of an archive, in order; one record is held at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary in a skippable frame")
    made = zstandard.ZstdCompressionDict(stream.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=made).stream_reader(stream, read_across_frames=True)
    buffered = io.BufferedReader(reader, 1 << 20)
    while (record := Record.read(buffered)) is not None:
        yield record


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder's address, as the tasks see it."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _responses(pages: DataFrame) -> DataFrame:
    """``(payload_key, response_id)`` of payloads of at least ``LEAST_REVISIT`` bytes that several pages have.

    Counted on digests; no payload is shuffled, and copies are one row per task in the shuffle.
    """
    keyed = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2("html", 256).alias("payload_key"))
    return keyed.groupBy("payload_key").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")


WRITTEN = StructType([StructField("path", StringType()), StructField("n_records", LongType()), StructField("n_bytes", LongType())])


def write(pages: DataFrame, folder: str, date: str = "2025-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives of ``pages(page_id, url, html, ...)`` below ``folder`` and returns ``(path, n_records, n_bytes)``.

    The payload is the html in UTF-8, empty for null. Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one
    with the largest ``page_id`` is a response and the others revisit it; rows that repeat this id are responses too. A null
    ``page_id`` counts as the smallest, and is a response if all copies are null. A null url is empty. Each row is one record;
    an empty table writes no archive. Very long pages are one record each.
    """
    pages = narrow(pages, "page_id", "url", "html")
    copies = stored(_responses(pages), "warc-responses")
    keyed = pages.withColumn("payload_key", F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha2("html", 256)))
    marked = keyed.join(copies, "payload_key", "left").select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.col("response_id").cast("long").alias("response_id"),
    )

    def run(batches: Batches) -> Batches:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        attempt = f"{task.partitionId():06d}-{uuid.uuid4().hex}"
        done, writer, stream, name, n = [], None, None, "", 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, response = (batch.column(i)[row].as_py() for i in range(4))
                if writer is None:
                    name, n = f"{root}/pages-{task.partitionId():06d}-{len(done):04d}.warc.zst", 0
                    stream = files.open_output_stream(f"{root}/_{attempt}-{len(done):04d}", compression=None)
                    writer = ArchiveWriter(stream, date)
                writer.add(_record(page_id, url, html, response))
                n += 1
                if writer.size >= archive_bytes:
                    done.append(_finish(files, root, attempt, len(done), writer, stream, name, n))
                    writer = None
        if writer is not None:
            done.append(_finish(files, root, attempt, len(done), writer, stream, name, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), *[pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]], WRITTEN.names
        )

    return stored(marked.mapInArrow(run, WRITTEN), "warc-manifest")


def _record(page_id: int | None, url: str | None, html: str | None, response: int | None) -> Record:
    payload = (html or "").encode("utf-8", "surrogatepass")
    revisit = response is not None and page_id != response
    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    return Record(page_id, url or "", len(payload), digest, payload, response if revisit else None, revisit)


def _finish(files, root: str, attempt: str, k: int, writer: ArchiveWriter, stream, name: str, n: int) -> tuple[str, int, int]:
    writer.close()
    size = stream.tell()
    stream.close()
    files.move(f"{root}/_{attempt}-{k:04d}", name)
    return name, n, size


RECORDS = StructType([
    StructField("page_id", LongType()), StructField("url", StringType()), StructField("payload_bytes", LongType()),
    StructField("payload_digest", StringType()), StructField("record_type", StringType()), StructField("refers_to", LongType()),
    StructField("payload", StringType()),
])


def read(written: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``written(path, ...)``; each archive, of a bounded size, is read by one task.

    ``payload`` is null for revisits, and throughout without ``with_payload``. Digests of responses are verified.
    """
    def run(batches: Batches) -> Batches:
        files, _ = _open(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    records = read_archive(stream)
                    while part := list(islice(records, 256)):
                        yield _rows(part, with_payload)

    n = written.count()
    spread = written.select("path").repartition(max(1, min(n, 10_000)), "path")
    return spread.mapInArrow(run, RECORDS)


def _rows(part: list[Record], with_payload: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r.page_id for r in part], pa.int64()), pa.array([r.url for r in part], pa.string()),
        pa.array([r.payload_bytes for r in part], pa.int64()), pa.array([r.digest for r in part], pa.string()),
        pa.array(["revisit" if r.is_revisit else "response" for r in part], pa.string()),
        pa.array([r.refers_to for r in part], pa.int64()),
        pa.array([r.payload if with_payload and not r.is_revisit else None for r in part], pa.binary()).cast(pa.string()),
    ], RECORDS.names)


def archive_folder(pages: DataFrame) -> str:
    """A fresh folder for archives below the shared one."""
    return work_folder(pages.sparkSession, "warc")
