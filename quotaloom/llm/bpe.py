"""Byte-level BPE: each distinct word of the corpus is merged once, and its ids go back to every place it stands in.

Words are cut so that no match of the pre-token pattern crosses a cut: before a single space, around a single line end,
and before a comma or dot between a letter or digit and one of these.  A text in which such a cut could split a match
(white space in a row, runs of marks) is cut into the matches themselves.

1. Each chunk numbers its words; a document becomes the numbers of its words by position.
2. Distinct words meet in buckets of a hash, over all chunks; each is encoded once there.
3. Ids go back to the chunk, which puts every document together by position.
Decoding looks up each id in the token-byte table; that has one entry for each id of the vocabulary and is broadcast.

Null and empty texts give no ids.  Repeated rows and rows with a null id each give a row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaloom.llm import common

WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: where the quick cuts could split a match: white space in a row or at an end, and a run of marks that a comma or dot ends
TIGHT = re.compile(rf"[{WHITE}]{{2}}|^[{WHITE}]|[{WHITE}]\Z|[\W_][,.][ \n]|\0")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file; a vocabulary is a fixed, small file, so it is read on the driver and broadcast."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def word_cutter(pattern: str):
    import regex

    exact = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))

    def cut(text: str) -> list[str]:
        if TIGHT.search(text):
            return exact.findall(text)
        text = text.replace(", ", "\0, ").replace(". ", "\0. ").replace(".\n", "\0.\n").replace(",\n", "\0,\n")
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    return cut


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id",
           chunk_bytes: int = common.CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """doc_id, ids: the ids of the whole text as little-endian unsigned 32-bit integers, by position."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    buckets = min(buckets or common.shuffle_width(spark), 1 << 16)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, new_chunk = word_cutter(pattern), common.chunk_ids()
        for rows in common.gather(batches, chunk_bytes):
            numbers, codes = common.Numbering(), []
            for x in rows["text"].to_pylist():
                codes.append(np.array(list(map(numbers.__getitem__, cut(x))) if x else [], np.uint32))
            chunk = next(new_chunk)
            words = [x.encode("utf-8", "surrogatepass") for x in numbers]
            flat, words, at = common.ranked(words, np.concatenate(codes), buckets)
            yield common.message("text", chunk, payload=common.pack(flat, at), ids=rows["doc_id"].to_pylist(),
                                 sizes=[len(x) for x in codes])
            order, ends = common.by_bucket(at, buckets)
            for bucket, a, b in common.split_at(ends):
                yield common.message("words", chunk, bucket, common.pack_words([words[i] for i in order[a:b].tolist()]))

    def merge(asked: pa.Table) -> pa.Table:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = []
        for row in asked.to_pylist():
            words, _ = common.unpack_words(row["payload"])
            fresh = [x for x in words if x not in known]
            known.update(zip(fresh, map(own.encode_ordinary, (x.decode("utf-8", "surrogatepass") for x in fresh))))
            ids = [known[x] for x in words]
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            out.append(row | {"kind": "ids", "payload": common.pack(np.fromiter(map(len, ids), np.uint32, len(ids)), flat)})
        return pa.Table.from_pylist(out, schema=common.MESSAGE_SCHEMA)

    def together(texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows = texts.to_pylist()
        parts = [common.unpack(r["payload"]) for r in sorted(replies.to_pylist(), key=lambda r: r["bucket"])]
        sizes = np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(p[1] for p in parts)])
        codes, buckets_of = common.unpack(rows[0]["payload"])
        place = common.in_rank(buckets_of)
        starts, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        at, out = 0, []
        for n in rows[0]["sizes"]:
            own = codes[at:at + n]
            at += n
            out.append(flat[common.spans(starts[own], sizes[own])].astype("<u4").tobytes())
        return pa.table({"doc_id": pa.array(rows[0]["ids"], pa.int64()), "ids": pa.array(out, pa.binary())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = common.stored(rows.mapInArrow(number, common.MESSAGES))
    replies = read("words").groupBy("bucket").applyInArrow(merge, common.MESSAGES)
    return read("text").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(together, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """The columns of encoded and decoded: the bytes of the ids' tokens behind each other; null ids give null."""
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts, text = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)
        for part in common.gather(batches, 4 << 20, ids):
            out = []
            for x in part[ids].to_pylist():
                own = np.frombuffer(x or b"", "<u4").astype(np.int64)
                out.append(None if x is None else text[common.spans(starts[own], sizes[own])].tobytes())
            yield from part.append_column("decoded", pa.array(out, pa.binary())).combine_chunks().to_batches()

    return encoded.mapInArrow(look_up, schema)


def ids_array(column: str):
    """The packed ids as array<bigint>, JVM-side."""
    digits = F.hex(F.col(column))
    size = (F.length(F.col(column)) / 4).cast("int")

    def number(i):
        return F.conv(F.concat(*[F.substring(digits, (i * 8 + k).cast("int"), F.lit(2)) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), size - 1), number))
