"""Chunks and packed messages shared by the operators that number words inside tasks.

A chunk is a run of whole documents of one input partition, closed when it holds CHUNK_BYTES of text (a longer text is a
chunk of its own).  Inside a chunk words get small numbers, so that what is shuffled is one packed message for each
(chunk, bucket) instead of one row for each word.  A word is in a chunk's message once, however often it occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotaloom.session import checkpoint_dir, materialize, shuffle_width, spread

__all__ = ["checkpoint_dir", "materialize", "shuffle_width", "spread"]

#: bytes of text that close a chunk
CHUNK_BYTES = 8 << 20
MESSAGES = "kind string, chunk long, bucket int, ids array<long>, sizes array<int>, marks array<int>, payload binary"
#: what splits words where a contract says [^\x20\x09-\x0D]+; bytes.split() splits on exactly these six bytes
SPACES = "\t\n\x0b\x0c\r "


def window(*keys: str, order: Any) -> Any:
    return Window.partitionBy(*keys).orderBy(order)


def fold(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null counts as empty.  Lone surrogates cannot occur in a Spark string."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings behind each other, compressed byte plane by byte plane.  unpack() needs no schema."""
    parts = [np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.ascontiguousarray(x) for x in arrays]
    head = np.array([len(parts)] + [v for x in parts for v in (ord(x.dtype.char), len(x))], np.int64)
    planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in parts]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *planes]))


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for kind, length in head.reshape(-1, 2).tolist():
        kind = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += length * kind.itemsize
    return out


def pack_words(words: list[bytes], *more: np.ndarray) -> bytes:
    return pack(np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words), *more)


def unpack_words(payload: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    sizes, text, *more = unpack(payload)
    raw, ends = text.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)], more


class Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: Any) -> int:
        self[key] = number = len(self)
        return number


def gather(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.Table]:
    """Tables of whole rows with about limit bytes of text; null texts take part as they are."""
    held, size = [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = pc.fill_null(pc.binary_length(table[text]), 0).to_numpy().astype(np.int64)
        start = 0
        while start < len(sizes):
            ahead = np.cumsum(sizes[start:])
            stop = start + int(np.searchsorted(ahead, max(0, limit - size))) + 1
            part = table.slice(start, min(stop, len(sizes)) - start)
            held.append(part)
            size += int(ahead[part.num_rows - 1])
            start += part.num_rows
            if size >= limit:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def chunk_ids() -> Iterator[int]:
    """Ids that no other task gives; the rows that carry them are written before they are used."""
    task = TaskContext.get()
    start = (task.partitionId() if task else 0) << 24
    return iter(range(start, start + (1 << 24)))


def rows_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


MESSAGE_SCHEMA = pa.schema([
    ("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32())), ("payload", pa.binary())])


def message(kind: str, chunk: int, bucket: int = -1, payload: bytes = b"", ids: Any = None, sizes: Any = None,
            marks: Any = None) -> pa.RecordBatch:
    return rows_of(MESSAGE_SCHEMA, [{"kind": kind, "chunk": chunk, "bucket": bucket, "ids": ids, "sizes": sizes,
                                     "marks": marks, "payload": payload}])


def stored(messages: DataFrame) -> Callable[[str], DataFrame]:
    """Write messages in the shared folder, dealt by chunk as the session shuffles; gives a reader of one kind.

    A later grouping by chunk finds the written rows where they have to be, so only what it joins to them moves.
    """
    spark, name = messages.sparkSession, f"messages_{uuid.uuid4().hex}"
    folder = f"{checkpoint_dir(spark)}/{name}"
    writer = messages.write.partitionBy("kind").bucketBy(shuffle_width(spark), "chunk").format("parquet")
    writer.option("path", folder).saveAsTable(name)
    rows = spark.table(name)
    return lambda kind: rows.where(F.col("kind") == kind)


def kept_by(key: str, rows: DataFrame) -> DataFrame:
    """Rows moved to where their key belongs and written there: later groupings by it move nothing."""
    spark, width, name = rows.sparkSession, shuffle_width(rows.sparkSession), f"kept_{uuid.uuid4().hex}"
    writer = rows.repartition(width, key).write.bucketBy(width, key).format("parquet")
    writer.option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def ranked(words: list[bytes], codes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number words anew by falling frequency, which packs well: the codes, the words in that order, and their buckets."""
    from zlib import crc32

    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    words = [words[i] for i in order.tolist()]
    return rank[codes], words, (np.fromiter(map(crc32, words), np.uint32, len(words)) % buckets).astype(np.uint16)


def by_bucket(at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket's run ends; replies put in this order belong to the ranked words."""
    return np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=buckets))


def in_rank(at: np.ndarray) -> np.ndarray:
    """Where in the replies, put by bucket, the word of each rank stands."""
    out = np.empty(len(at), np.int64)
    out[np.argsort(at, kind="stable")] = np.arange(len(at))
    return out


def split_at(ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of every run that holds something."""
    start = 0
    for bucket, stop in enumerate(ends.tolist()):
        if stop > start:
            yield bucket, start, stop
        start = stop


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each (start, size), behind each other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)
