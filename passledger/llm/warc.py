"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame that holds a dictionary built from its first
records; every record is one Zstandard frame of its own. A payload that is met again
is written as a revisit of the record with the largest page_id. Archives are closed at
a bounded size and lie in a shared folder; a manifest names those of tasks that
succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger.llm.common import whole
from passledger.session import scratch_path

#: Fixed values of the format.
_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def _field(value: str) -> str:
    """Keeps a header on its line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed; a revisit keeps the HTTP head of its payload and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_field(url or '')}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A trained dictionary, or none when the samples are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(content: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content) if content else None)


def _records_of(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an archive."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != _SKIPPABLE:
        raise ValueError("the archive does not begin with its dictionary")
    content = stream.read(size)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None).stream_reader(
        stream, read_across_frames=True
    )
    held, ended = b"", False

    def more() -> bool:
        nonlocal held, ended
        part = plain.read(1 << 18)
        held += part
        ended = not part
        return not ended

    while True:
        while (cut := held.find(_END)) < 0 and more():
            pass
        if cut < 0:
            if held:
                raise ValueError("the archive ends inside a record")
            return
        lines = held[:cut].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        end = cut + len(_END) + int(head["Content-Length"])
        parts, have = [held], len(held)
        while have < end + len(_END):
            part = plain.read(1 << 18)
            if not part:
                raise ValueError("the archive ends inside a record")
            parts.append(part)
            have += len(part)
        held = b"".join(parts)
        yield head, held[cut + len(_END) : end]
        held = held[end + len(_END) :]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(
    pages: DataFrame, folder: str, smallest: int = 0, archive_bytes: int = 16_000_000, level: int = 6,
    date: str = "2000-01-01T00:00:00Z", learn_from: int = 2_000_000,
) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns the manifest.

    ``folder`` is one that all executors share and pyarrow can open. Payloads of at
    least ``smallest`` bytes that are equal share one response, that with the largest
    page_id; shorter ones and rows without a page_id are always responses. Null html is
    an empty payload. Each archive learns its dictionary from the beginnings (8,192
    bytes) of its first records, ``learn_from`` bytes of them; this decides nothing but
    the compression. The manifest has one row for each archive: path, records. An empty
    table writes no archive; a repeated page_id gets a record for each of its rows, with
    equal payloads both a response if it is the largest; other columns are not written.
    """
    body = whole("html").cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"),
        F.sha2(body, 256).alias("content"),
    )
    first = rows.groupBy("content").agg(F.max("page_id").alias("first_id"))
    placed = rows.join(first, "content").select(
        "page_id", "url", "payload",
        F.when((F.octet_length("payload") >= smallest) & (F.col("page_id") < F.col("first_id")), F.col("first_id")).alias("refers_to"),
    )
    target = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _filesystem(target)
        system.create_dir(path, recursive=True)
        number = 0

        def plain():
            for batch in batches:
                for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    yield record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date)

        records = plain()
        pending = next(records, None)
        while pending is not None:
            start, held = [], 0
            while pending is not None and held < learn_from:
                start.append(pending)
                held += len(pending)
                pending = next(records, None)
            content = dictionary([r[:8_192] for r in start])
            press = _compressor(content, level)
            name = f"{path}/{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.zst"
            with system.open_output_stream(name, compression=None) as out:
                out.write(struct.pack("<II", _SKIPPABLE, len(content)) + content)
                for item in start:
                    out.write(press.compress(item))
                count = len(start)
                start.clear()
                while pending is not None and out.tell() < archive_bytes:
                    out.write(press.compress(pending))
                    count += 1
                    pending = next(records, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["path", "records"])

    manifest = f"{target}-manifest"
    placed.mapInArrow(run, "path string, records bigint").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def read_archives(manifest: DataFrame, folder: str, archives_in_task: int = 8) -> DataFrame:
    """Every record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response come from its payload, which must match the digest
    in its head; those of a revisit are what its head says of the payload it refers to.
    Archives are dealt by number: a task for each as long as there are no more of them
    than shuffle partitions, and ``archives_in_task`` beyond that.
    """
    target = folder.rstrip("/")

    def rows(path: str, system) -> Iterator[tuple]:
        with system.open_input_stream(path, compression=None) as stream:
            for head, block in _records_of(stream):
                http, _, payload = block.partition(_END)
                page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    if payload_digest(payload) != digest:
                        raise ValueError(f"a payload of {path} does not match its digest")
                    size = len(payload)
                else:
                    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
                yield (page and int(page), size, digest, head["WARC-Type"], refers and int(refers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        system, _ = _filesystem(target)
        for batch in batches:
            for path in batch.column("path"):
                held = []
                for row in rows(path.as_py(), system):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    count = manifest.count()
    tasks = max(-(-count // archives_in_task), min(count, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    return manifest.select("path").repartitionByRange(tasks, "path").mapInArrow(run, _SCHEMA)


def archived(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` into a new shared folder and reads the archives back."""
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)
