"""Token-ID output in fixed-width bit packing (operator 8).

Every id takes the minimum bits of its vocabulary.  Documents are range-partitioned
and sorted by doc_id; each task encodes its documents and writes shards, one row of
``image`` bytes each, through Spark's own commit, so a lost executor costs a task and
never a half-written file.  A shard image is

    magic "FWBP", u8 version, u8 bits, u16 zero, u32 ids per block,
    u64 ids, u64 documents, u64 blocks,
    i64 doc_id[documents], u64 first id[documents + 1], u64 block byte offset[blocks + 1],
    payload: blocks of packed ids, little-endian bits, each block byte-aligned

so numpy unpacks a block at once and any document is read from its own blocks alone.

Tokenising: ``encoder.ByteEncoder`` cuts texts where tokens must start and encodes each
distinct piece once per worker.

Defined results: null text is empty and holds the end id only; equal doc_ids are ordered
by a hash of their text; a null doc_id sorts first and reads back as null; an empty table
gives no shard; other columns are ignored.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, stage
from .encoder import ByteEncoder, encoder

MAGIC = b"FWBP"
BLOCK_IDS = 4096
SHARD_IDS = 1 << 20
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
SLICE = 1 << 20            # bytes of text cut up at once
NO_DOC = -(1 << 63)        # doc_id of a null in an image


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    flat = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n * bits]
    return (flat.reshape(n, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)) \
        .sum(axis=1).astype(np.uint32)


def image(doc_ids: np.ndarray, docs: list[np.ndarray], bits: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    blocks = [pack(ids[i:i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + struct.pack("<BBHIQQQ", 1, bits, 0, BLOCK_IDS, len(ids), len(docs), len(blocks))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), first.tobytes(), at.tobytes(), *blocks])


class Shard:
    """Reader of an image; ``doc(i)`` touches only the blocks of document i."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard image")
        _, self.bits, _, self.block, self.n, self.docs, blocks = struct.unpack_from("<BBHIQQQ", data, 4)
        at = 4 + struct.calcsize("<BBHIQQQ")
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, at)
        self.first = np.frombuffer(data, "<u8", self.docs + 1, at + 8 * self.docs).astype(np.int64)
        at += 16 * self.docs + 8
        self.at = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.data, self.base = data, at + 8 * (blocks + 1)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, -(-b // self.block)
        got = [unpack(self.data[self.base + self.at[k]:self.base + self.at[k + 1]], self.bits,
                      min(self.block, self.n - k * self.block)) for k in range(i, j)]
        return np.concatenate(got)[a - i * self.block:b - i * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(self.first[i], self.first[i + 1])


def write(docs: DataFrame, name: str = "tokens", vocabulary: str = VOCABULARY,
          end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Write the shards of all documents; (shards, place of each task's first id).

    shards: part, before (ids before it in the part), n_ids, image.  Parts are in
    doc_id order; ``places`` has one row per part."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ByteEncoder, vocabulary)
        bits = width(max(enc.tok.get_vocab_size(), end_id + 1))
        end = np.array([end_id], np.uint32)
        part, before = TaskContext.get().partitionId(), 0
        ids, held, n = [], [], 0

        def out():
            nonlocal before, ids, held, n
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([n], pa.int64()), pa.array([image(np.array(ids, np.int64), held, bits)],
                                                     pa.binary())],
                ["part", "before", "n_ids", "image"])
            before, ids, held, n = before + n, [], [], 0
            return row

        for b in pieces(batches, limit=SLICE):
            doc_ids = pc.fill_null(b.column("doc_id"), NO_DOC).to_pylist()
            for d, x in zip(doc_ids, enc.encode(b.column("text")), strict=True):
                held.append(np.concatenate([x, end], dtype=np.uint32))
                ids.append(d)
                n += len(x) + 1
                if n >= SHARD_IDS:
                    yield out()
        if ids:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")) \
        .withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h") \
        .sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    files = stage(ordered.mapInArrow(shards, "part int, before long, n_ids long, image binary"), name)
    # one row per task of the writer: small whatever the corpus
    total = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    places = total.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("place"))
    return files, places


def digest(files: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the shards."""
    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, before, data in zip(*(b.column(c).to_pylist() for c in
                                             ("place", "before", "image")), strict=True):
                s = Shard(data)
                ids = s.ids(0, s.n)
                le = ids.astype("<u4")
                crc = [zlib.crc32(le[a:z]) for a, z in zip(s.first[:-1], s.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=s.doc_ids == NO_DOC),
                     pa.array(s.first[:-1] + place + before),
                     pa.array(np.diff(s.first)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(places, "part").select("place", "before", "image").mapInArrow(
        docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_doc(files: DataFrame, doc_id: int) -> list[list[int]]:
    """Ids of each stored document of that id, by random access to its blocks."""
    def one(batches):
        for b in batches:
            for data in b.column("image").to_pylist():
                s = Shard(data)
                got = [s.doc(i).tolist() for i in np.flatnonzero(s.doc_ids == doc_id)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int64()))], ["ids"])

    return [r.ids for r in files.select("image").mapInArrow(one, "ids array<long>").collect()]
