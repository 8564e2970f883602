"""Best-fit packing by the sum-of-squares rule (operator 12).

A document's token ids, with an end id, fill sequences of ``CAPACITY`` tokens.  Only a
longer document is cut, into pieces of ``CAPACITY``; its last piece may be shorter.  Pieces
are placed one by one, longest first: a piece goes where the sum, over the residual gaps,
of the squared numbers of open sequences with that gap becomes smallest.  New sequences are
open to this choice until as many are open as the pieces fill at the least; from then on
one is opened only for a piece that fits nowhere.

A task tokenises its documents and packs ``CHUNK`` tokens at a time, so ids never move but
for the worst-filled sequences of a chunk: those with more than ``SLACK`` free places, an
eighth of the chunk at most (one at least), are undone and packed again with those of other
chunks, in rounds of an eighth of the tokens each, until one chunk holds the rest.  Each
round is written to the shared folder.

Defined results: null text is empty and holds the end id only; a null doc_id is kept;
repeated rows are documents of their own; ties go to the smaller gap and the latest
sequence; an empty table gives no sequence; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stage
from .encoder import WordEncoder, encoder

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CHUNK = 1 << 22            # tokens packed together
SLACK = 4                  # free places of a sequence that is left as it is
UNDONE = 8                 # one in so many sequences of a chunk is packed again at most
PLACE = "struct<doc_id:long,piece:int,start:long,length:int>"
ROW = f"sequence_id long, n_tokens int, ids binary, pieces array<{PLACE}>"


def sum_of_squares(length: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(sequence of each piece, number of sequences).  Lengths are 1 to ``capacity``."""
    length = np.asarray(length, np.int64)
    least = -(-int(length.sum()) // capacity)
    n_open = np.zeros(capacity + 1, np.int64)          # sequences per residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.zeros(len(length), np.int64)
    used, never = 0, np.int64(1) << 60
    for i in np.argsort(-length, kind="stable"):
        s = int(length[i])
        if s == capacity:
            out[i] = used
            used += 1
            continue
        # change of the sum of squares when a gap g >= s becomes g - s; a full sequence
        # (gap 0) no longer counts
        gap = n_open[s:capacity]
        change = 2 * (n_open[:capacity - s] - gap) + 2
        change[0] = 1 - 2 * gap[0]
        change[gap == 0] = never
        best = int(change.argmin())
        if change[best] == never or (used < least and change[best] > 2 * n_open[capacity - s] + 1):
            g, to = capacity, used
            used += 1
        else:
            g = s + best
            to = stacks[g].pop()
            n_open[g] -= 1
        out[i] = to
        if g > s:
            n_open[g - s] += 1
            stacks[g - s].append(to)
    return out, used


def _pack(chunk: list[tuple], capacity: int, last: bool) -> Iterator[tuple]:
    """(closed, n_tokens, ids, pieces) of one chunk of (doc_id, piece, start, ids)."""
    length = np.fromiter((len(c[3]) for c in chunk), np.int64, len(chunk))
    place, n = sum_of_squares(length, capacity)
    filled = np.bincount(place, length, n).astype(np.int64)
    again = np.zeros(n, bool)
    if not last:
        worst = np.argsort(filled, kind="stable")[:max(1, n // UNDONE)]
        again[worst[filled[worst] < capacity - SLACK]] = True
    members = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place, minlength=n))[:-1])
    for b, of in enumerate(members):
        for part in ([[i] for i in of] if again[b] else [of]):
            got = [chunk[i] for i in part]
            ids = np.concatenate([g[3] for g in got])
            yield not again[b], len(ids), ids.tobytes(), [
                {"doc_id": d, "piece": p, "start": a, "length": len(x)} for d, p, a, x in got]


_PLACES = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()),
                              ("start", pa.int64()), ("length", pa.int32())]))


def _rows(packed: list[tuple], base: int) -> tuple[pa.RecordBatch, int]:
    """Rows of sequences; pieces to be packed again have negative numbers, all different."""
    n = base + len(packed)
    names = [i if p[0] else -i - 1 for i, p in enumerate(packed, base)]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array([p[1] for p in packed], pa.int32()),
         pa.array([p[2] for p in packed], pa.binary()), pa.array([p[3] for p in packed], _PLACES)],
        ["sequence_id", "n_tokens", "ids", "pieces"]), n


def _batches(packed: Iterator[tuple], base: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, int]]:
    held: list[tuple] = []
    for p in packed:
        held.append(p)
        if len(held) == rows:
            b, base = _rows(held, base)
            held = []
            yield b, base
    if held:
        b, base = _rows(held, base)
        yield b, base


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID,
         chunk: int = CHUNK, name: str = "best-fit") -> DataFrame:
    """Sequences of all documents: sequence_id, n_tokens, ids (little-endian unsigned, two
    bytes each for a vocabulary of at most 65,536 ids, else four) and the pieces in them,
    in the order of their ids: doc_id, piece, start (ids of the document before it), length."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(WordEncoder, vocabulary)
        kind = "<u2" if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], kind)
        base = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for b in pieces(batches):
            for d, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                ids = np.concatenate([x.astype(kind), end])
                held += [(d, k, at, ids[at:at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
                size += len(ids)
                if size >= chunk:
                    for rows, base in _batches(_pack(held, capacity, False), base):
                        yield rows
                    held, size = [], 0
        for rows, base in _batches(_pack(held, capacity, False), base) if held else ():
            yield rows

    def later(round_no: int, last: bool):
        def group(key: tuple, t: pa.Table) -> pa.Table:
            wide = "<u2" if len(t) and len(t["ids"][0].as_py()) == 2 * t["n_tokens"][0].as_py() else "<u4"
            t = t.sort_by([("sequence_id", "descending")])
            held = [(p[0]["doc_id"], p[0]["piece"], p[0]["start"], np.frombuffer(ids, wide))
                    for p, ids in zip(t["pieces"].to_pylist(), t["ids"].to_pylist(), strict=True)]
            base = (round_no << 56) + (key[0].as_py() << 32)
            return pa.Table.from_batches([_rows(list(_pack(held, capacity, last)), base)[0]])
        return group

    done = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, ROW), name)
    out = done.where("sequence_id >= 0")
    for round_no in range(1, 100):
        loose = done.where("sequence_id < 0")
        tokens = loose.agg(F.sum("n_tokens")).first()[0]
        if not tokens:
            return out
        groups = -(-tokens // chunk)
        by = F.pmod(F.xxhash64("sequence_id"), F.lit(groups))
        done = stage(loose.groupBy(by.alias("g")).applyInArrow(later(round_no, groups == 1), ROW),
                     f"{name}-{round_no}")
        out = out.unionByName(done.where("sequence_id >= 0"))
    raise RuntimeError("packing did not end")


def digest(sequences: DataFrame) -> DataFrame:
    """A row per piece, read back from the sequences: doc_id, piece, start, length,
    ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit), sequence_id, offset."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("pieces")
            p = lists.flatten()
            n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            length = np.asarray(p.field("length")).astype(np.int64)
            crc, offset, at = [], [], 0
            for size, tokens, ids in zip(n, b.column("n_tokens").to_pylist(), b.column("ids").to_pylist(),
                                         strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * tokens else "<u4").astype("<u4")
                start = 0
                for k in length[at:at + size]:
                    offset.append(start)
                    crc.append(zlib.crc32(wide[start:start + k]))
                    start += int(k)
                if start != tokens:
                    raise ValueError("pieces do not fill their sequence")
                at += size
            yield pa.RecordBatch.from_arrays(
                [p.field("doc_id"), p.field("piece"), p.field("start"), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.repeat(np.asarray(b.column("sequence_id")), n), pa.int64()),
                 pa.array(offset, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return sequences.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                      "sequence_id long, offset long")
