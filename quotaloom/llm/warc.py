"""WARC archives: write, normalise to a gzip member for each record with a sidecar index, and read by that index.

write_archives  one archive for each partition, deflated as one whole-file stream.  Records with equal payloads become one
                response (the smallest page id) and revisits, which carry the HTTP head but not the payload.
normalise       inflates an archive's stream once, in pieces, and rewrites every record as a gzip member of its own, next
                to a sidecar of tab-separated lines: offset, length, record id.  Archives of several members are read too.
read_records    reads records by offset from the sidecars; ranges of an archive can be read by different tasks.

Files go to a folder all machines share.  A task writes under a name of its own attempt and renames at the end, so that a
task that is run again leaves the same files.  Null html is an empty payload; a null url leaves out the target header; a
null page id is written as such and never becomes the response that others refer to, unless all of its group are null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaloom.llm import common

PIECE = 1 << 20
#: bytes that one step of inflating gives at most, however well they were packed
INFLATED = 4 << 20
#: bytes of an archive that one task reads
READ_BYTES = 32 << 20
ARCHIVES = "path string, records long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
           "payload binary, digest_ok boolean")
URN = "urn:x-page:"


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Placed:
    """A file that gets its name once it is whole."""

    def __init__(self, path: str):
        self.fs, self.path = store(path)
        task = TaskContext.get()
        self.own = f"{self.path}.{task.taskAttemptId() if task else 0}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file, self.size = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head_value(text: str) -> str:
    """A header value: control characters, which would end the line, percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {head_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def heads(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file, whether it is one stream or many members, at most INFLATED at once; a stream without its end is an error."""
    stream, begun = zlib.decompressobj(31), False
    for piece in pieces:
        begun = True
        while piece:
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(piece, INFLATED)
            piece = stream.unused_data if stream.eof else stream.unconsumed_tail
    while begun and not stream.eof:
        rest = stream.decompress(b"", INFLATED)
        if not rest and not stream.eof:
            raise ValueError("the archive ends within a gzip stream")
        yield rest


def records_in(data: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, head and block, one at a time."""
    held = bytearray()

    def need(size: int) -> None:
        while len(held) < size:
            piece = next(data, None)
            if piece is None:
                raise ValueError("the archive ends within a record")
            held.extend(piece)

    while True:
        end = held.find(b"\r\n\r\n")
        while end < 0:
            piece = next(data, None)
            if piece is None:
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
            at = max(0, len(held) - 3)
            held.extend(piece)
            end = held.find(b"\r\n\r\n", at)
        size = end + 4 + int(heads(bytes(held[:end]))["content-length"]) + 4
        need(size)
        yield bytes(held[:size])
        del held[:size]


def pieces_of(path: str) -> Iterator[bytes]:
    fs, name = store(path)
    with fs.open_input_stream(name, compression=None) as source:
        while piece := source.read(PIECE):
            yield piece


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 4) -> DataFrame:
    """Write the archives; gives their paths and numbers of records (a written table)."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # few payloads repeat; Spark broadcasts the written table only if its size allows
    shared = common.materialize(shared.select("digest", "first"))
    rows = rows.join(shared, "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n, first = TaskContext.get(), None, 0, set()
        stream = zlib.compressobj(level, zlib.DEFLATED, 31)
        path = f"{folder}/part-{task.partitionId() if task else 0:06d}.warc.gz"
        for batch in batches:
            out = out or Placed(path)
            for i in range(batch.num_rows):
                own, address, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                out.write(stream.compress(record(own, address, payload, refers)))
            n += batch.num_rows
        if out:
            out.write(stream.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return common.materialize(common.spread(rows).mapInArrow(write, ARCHIVES))


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite each archive (column path) into folder; gives path and records of the new archives (a written table)."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, n = f"{folder}/{source.rpartition('/')[2]}", 0
                members, index = Placed(path), Placed(f"{path}.idx")
                for raw in records_in(inflated(pieces_of(source))):
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = member.compress(raw) + member.flush()
                    name = heads(raw[:raw.index(b"\r\n\r\n")]).get("warc-record-id", "")
                    index.write(f"{members.size}\t{len(data)}\t{name}\n".encode())
                    members.write(data)
                    n += 1
                members.close()
                index.close()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    width = common.shuffle_width(archives.sparkSession)
    return common.materialize(archives.select("path").repartition(width, "path").mapInArrow(rewrite, ARCHIVES))


def page_number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if digits else None


def parse(raw: bytes) -> dict:
    at = raw.index(b"\r\n\r\n")
    own = heads(raw[:at])
    block = raw[at + 4:at + 4 + int(own["content-length"])]
    cut = block.index(b"\r\n\r\n")
    revisit = own["warc-type"] == "revisit"
    payload = None if revisit else block[cut + 4:]
    digest = own["warc-payload-digest"].removeprefix("sha1:")
    return {"page_id": page_number(own["warc-record-id"]), "url": own.get("warc-target-uri"), "record_type": own["warc-type"],
            "refers_to": page_number(own.get("warc-refers-to")), "payload_digest": digest,
            "payload_bytes": int(heads(block[:cut])["content-length"]) if revisit else len(payload),
            "payload": payload, "digest_ok": revisit or base32_sha1(payload) == digest}


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the normalised archives of a folder, found by the sidecar indexes."""
    lines = spark.read.schema("offset long, length long, name string").option("sep", "\t").option("quote", "").csv(f"{folder}/*.idx")
    spots = lines.select(F.regexp_replace(F.input_file_name(), r"\.idx$", "").alias("path"), "offset", "length")
    # the sidecar's name as Spark gives it is a URI
    spots = spots.withColumn("run", F.floor(F.col("offset") / READ_BYTES))
    spots = spots.repartition(common.shuffle_width(spark), "path", "run").sortWithinPartitions("path", "offset").select("path", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])
        opened, name = None, None
        for batch in batches:
            out, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    fs, local = store(path)
                    opened, name = fs.open_input_file(local), path
                opened.seek(offset)
                out.append(parse(zlib.decompress(opened.read(length), 31)))
                held += out[-1]["payload_bytes"]
                if held > 16 << 20:
                    yield common.rows_of(schema, out)
                    out, held = [], 0
            yield common.rows_of(schema, out)

    return spots.mapInArrow(read, RECORDS)
