"""Token-id files: documents as ids, in order of their ids, entropy-coded in blocks.

A file is a row of segments. A segment holds whole documents in ascending order
of id: a head with their ids and lengths, an index, and the blocks of all their
tokens, coded by :mod:`._coder`. Each block is reset and has a checksum of its
own, as has the head; a damaged block is found, and no other one depends on it.

    magic "ATK2", crc32 of the head              2 x 4 bytes
    vocabulary, documents, blocks, block size    4 x 4 bytes      \\
    ids of the documents                         8 bytes each      | head
    1 for an id, 0 for null                      1 byte each       |
    tokens of the documents                      4 bytes each      |
    words and crc32 of each block                2 x 4 bytes each /
    blocks                                       2 bytes a word

All numbers are little-endian. Segments go through Spark's own writer as one
binary column, beside the number of their file, their place in it and their
count of tokens, so files can be in any store that Spark writes to. Files are
ranges of ids, dealt out by sampled bounds, so none grows with the input.

Defined results: a null text counts as empty; a null id stands before all
others; repeated rows are documents of their own, in the order of a hash of
their texts; an empty table gives no segments; other columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _coder, _store, _tokens
from ._bytes import sliced, task

MAGIC = b"ATK2"
#: Tokens from which a segment is closed.
SEGMENT = 1 << 23


class Damaged(ValueError):
    pass


def pack(docs: list[int | None], ids: list[bytes], vocabulary: int) -> bytes:
    """One segment; ids are bytes of little-endian unsigned 32-bit integers."""
    tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    sizes, payloads = _coder.encode(tokens, vocabulary)
    blocks = [p.tobytes() for p in payloads]
    head = b"".join(
        (
            np.array([vocabulary, len(docs), len(blocks), _coder.BLOCK], "<u4").tobytes(),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is not None for d in docs], "u1").tobytes(),
            np.array([len(i) // 4 for i in ids], "<u4").tobytes(),
            np.array([[len(p), zlib.crc32(b)] for p, b in zip(payloads, blocks)], "<u4").tobytes(),
        )
    )
    return b"".join((MAGIC, np.array([zlib.crc32(head)], "<u4").tobytes(), head, *blocks))


def unpack(segment: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids of documents, their token counts, all tokens)."""
    if segment[:4] != MAGIC:
        raise Damaged("not a segment")
    vocabulary, n, blocks, block = np.frombuffer(segment, "<u4", 4, 8).tolist()
    at = 24
    docs = np.frombuffer(segment, "<i8", n, at).tolist()
    there = np.frombuffer(segment, "u1", n, at + 8 * n).tolist()
    counts = np.frombuffer(segment, "<u4", n, at + 9 * n).astype(np.int64)
    index = np.frombuffer(segment, "<u4", 2 * blocks, at + 13 * n).reshape(-1, 2)
    at += 13 * n + 8 * blocks
    if zlib.crc32(segment[8:at]) != np.frombuffer(segment, "<u4", 1, 4)[0] or block != _coder.BLOCK:
        raise Damaged("the head of a segment")
    payloads = []
    for i, (words, crc) in enumerate(index.tolist()):
        raw = segment[at : at + 2 * words]
        if zlib.crc32(raw) != crc:
            raise Damaged(f"block {i} of a segment")
        payloads.append(np.frombuffer(raw, "<u2"))
        at += 2 * words
    sizes = np.full(blocks, block, np.int64)
    if blocks:
        sizes[-1] = counts.sum() - block * (blocks - 1)
    return [d if t else None for d, t in zip(docs, there)], counts, _coder.decode(sizes, payloads, vocabulary)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by ``end_id``."""
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    # ids first; rows that share an id, or have none, are dealt by their texts, in whose order they stand
    ordered = d.withColumn("h", F.xxhash64("t")).repartitionByRange(_store.partitions(docs.sparkSession), "i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _tokens.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        ids: list[bytes] = []
        held = number = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "tokens": held, "segment": pack(names, ids, found.size)}], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("tokens", pa.int64()), ("segment", pa.binary())]))

        for batch in batches:
            for few in sliced(batch, "t", 4 << 20):
                for doc, own in zip(few.column("i").to_pylist(), found.encode(few.column("t"))):
                    names.append(doc)
                    ids.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= SEGMENT:
                        yield closed()
                        names, ids, held, number = [], [], 0, number + 1
        if names:
            yield closed()

    ordered.mapInArrow(task(run), "part int, number int, tokens long, segment binary").write.parquet(path, compression="uncompressed")


SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the files.

    ``start`` counts the tokens of all documents before; ``ids`` are bytes of
    little-endian unsigned 32-bit integers, null unless asked for.
    """
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n"))  # a row for each file
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = files.select("part", "number", "tokens").withColumn("within", F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = place.join(before, "part").select("part", "number", (F.col("before") + F.col("within")).alias("start"))
    # a row for each segment of millions of tokens
    placed = files.join(place, ["part", "number"]).select("start", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, segment in zip(batch.column("start").to_pylist(), batch.column("segment")):
                docs, counts, tokens = unpack(segment.as_py())
                raw = tokens.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array(start + ends - counts),
                    pa.array(counts),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    pa.array(own if with_ids else [None] * len(own), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return placed.mapInArrow(task(run), SCHEMA)
