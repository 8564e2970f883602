"""Sub-word ids by longest match against a given piece table.

The piece table has columns ``piece``, ``inner`` (the piece continues a word) and ``id``; it
is data, never trained here.  A word that is a piece takes its id.  Any other word is read
from the left: the longest piece that starts there, then the longest inner piece that starts
where it ended, and so on; a word with a place where no piece starts has the unknown id alone.

Words are encoded once for the corpus.  A filter of the pieces, of a bounded size, says where
they may lie in a word; the walk along the longest of them is taken beside the words, and only
the pieces on it meet the piece table in a join.  A word with a piece there that the table does
not have, as a filter may err, is encoded the exact way: its substrings of at most the longest
piece's length meet the piece table, and the longest match of each place stays.  Texts then get
the ids of their words by blocks of rows (``joins.look_up``).  There, words are cut into
overlapping windows first, so a word's substrings cost its length times the longest piece,
however long it is; very long words go this way at once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..sources.files import stage
from .encode import UNKNOWN_ID
from .joins import by_key, look_up, offsets

WINDOW = 256           # characters whose places one window holds
SLOTS = 1 << 20        # of 8 bytes that the filter has at most; about two pieces may share one
CHUNK = 1 << 20        # bytes of words walked at once; longer words go the exact way


@F.pandas_udf(ArrayType(LongType()))
def _walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ids of the longest matches in a row; None where a place has none.  ``hits`` of a
    word are (start, length, id), a start at most once."""
    for hits, sizes in batches:
        out = []
        for h, n in zip(hits, sizes, strict=True):
            at = {x["start"]: (x["length"], x["id"]) for x in (() if h is None else h)}
            ids, i = [], 0
            while i < n and i in at:
                ids.append(at[i][1])
                i += at[i][0]
            out.append(ids if i == n else None)
        yield pd.Series(out)


def longest_matches(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(wid, start, length, id): the longest piece at each place of each word (wid, word)."""
    longest = int(pieces.agg(F.max(F.length("piece"))).first()[0] or 1)
    n = F.length("word")
    windows = words.where(n > 0).select("wid", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / WINDOW).cast("int")),
        lambda k: F.substring(F.col("word"), k * WINDOW + 1, F.lit(WINDOW + longest - 1)))).alias("k", "part"))
    starts = windows.select("wid", "k", "part", F.explode(F.sequence(
        F.lit(0), F.least(F.lit(WINDOW), F.length("part")) - 1)).alias("s"))
    subs = starts.select(
        "wid", (F.col("k") * WINDOW + F.col("s")).alias("start"), F.col("part"), "s",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("part") - F.col("s")))).alias("length")) \
        .select("wid", "start", "length", (F.col("start") > 0).alias("inner"),
                F.substring("part", F.col("s") + 1, F.col("length")).alias("piece"))
    # merge joins: the planner takes exploded rows for as few as the words they come from
    return subs.join(pieces.select("piece", "inner", "id").hint("merge"), ["piece", "inner"]) \
        .groupBy("wid", "start").agg(F.max("length").alias("length"), F.max_by("id", "length").alias("id"))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all words, and where each begins, the end last."""
    w = pa.concat_arrays([words.cast(pa.large_string())])
    at = np.frombuffer(w.buffers()[1], np.int64)[w.offset:w.offset + len(w) + 1]
    data = np.frombuffer(w.buffers()[2] or b"", np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def _longer(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Fingerprints of strings that go on with a byte."""
    return h * np.uint64(0x9E3779B97F4A7C15) + byte.astype(np.uint64) + np.uint64(1)


def _marks(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each fingerprint in the filter, and its four bits there."""
    x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    one, low = np.uint64(1), np.uint64(63)
    bits = (one << ((x >> np.uint64(40)) & low)) | (one << ((x >> np.uint64(46)) & low)) | \
        (one << ((x >> np.uint64(52)) & low)) | (one << (x >> np.uint64(58)))
    return (x & np.uint64(slots - 1)).astype(np.int64), bits


def piece_filter(pieces: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the pieces, and the bytes of the longest one."""
    some = pieces.where("piece IS NOT NULL AND inner IS NOT NULL").select("piece", "inner")
    n, longest = some.agg(F.count(F.lit(1)), F.max(F.octet_length("piece"))).first()
    slots = min(SLOTS, 1 << int(n).bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _bytes(b["piece"])
            h, size = np.where(np.asarray(b["inner"].cast(pa.int8())) > 0, 2, 1).astype(np.uint64), np.diff(at)
            rows = np.arange(len(h))
            for k in range(int(size.max(initial=0))):
                rows = rows[size[rows] > k]
                h[rows] = _longer(h[rows], data[at[rows] + k])
            slot, bits = _marks(h, slots)
            yield pa.record_batch({"slot": slot, "bits": bits.view(np.int64)})

    marked = some.mapInArrow(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(slots, np.uint64)
    out[np.asarray(marked["slot"])] = np.asarray(marked["bits"]).view(np.uint64)
    return out, longest or 0


def _likely(data: np.ndarray, at: np.ndarray, marks: np.ndarray, longest: int) -> np.ndarray:
    """For every byte that begins a character, the bytes of the longest likely piece there; 0: none."""
    whole = np.append((data & 0xC0) != 0x80, True)
    end = np.repeat(at[1:], np.diff(at))
    places = np.flatnonzero(whole[:-1])
    first = np.zeros(len(data), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    h, best = np.where(first[places], 1, 2).astype(np.uint64), np.zeros(len(data), np.int64)
    for n in range(1, longest + 1):
        on = places + n <= end[places]
        places, h = places[on], h[on]
        if not len(places):
            break
        h = _longer(h, data[places + n - 1])
        done = np.flatnonzero(whole[places + n])
        slot, bits = _marks(h[done], len(marks))
        best[places[done[marks[slot] & bits == bits]]] = n
    return best


def _walks(marks: np.ndarray, longest: int):
    """(wid, at, inner, piece) of words (wid, word): the pieces of a walk in order; an empty
    one where no piece starts."""
    def some(wid: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        data, at = _bytes(words)
        best, rows, place = _likely(data, at, marks, longest), np.flatnonzero(np.diff(at) > 0), at[:-1][np.diff(at) > 0]
        found = [np.zeros((4, 0), np.int64)]
        while len(rows):
            n = best[place]
            found.append(np.stack([rows, np.full(len(rows), len(found)), place, n]))
            place = place + n
            on = (n > 0) & (place < at[rows + 1])
            rows, place = rows[on], place[on]
        rows, step, start, n = np.concatenate(found, axis=1)
        ends = np.cumsum(n)
        text = data[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]
        piece = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(
            np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
        return pa.record_batch({"wid": wid[rows], "at": step, "inner": pa.array(start > at[rows]), "piece": piece})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wid, size = np.asarray(b["wid"]), np.cumsum(np.asarray(pc.binary_length(b["word"])).astype(np.int64))
            cut = np.flatnonzero(np.diff(size // CHUNK, prepend=0)) if len(size) else []
            for i, j in zip([0, *cut], [*cut, len(size)], strict=True):
                if i < j:
                    yield some(wid[i:j], b["word"].slice(i, j - i))
    return run


def spelt_out(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, ids) of words (wid, word): longest matches the exact way; ids null: unknown."""
    hits = longest_matches(words, pieces).groupBy("wid").agg(
        F.collect_list(F.struct("start", "length", F.col("id").cast("bigint").alias("id"))).alias("hits"))
    return words.join(hits.hint("merge"), "wid", "left").select("word", _walk("hits", F.length("word")).alias("ids"))


def walked(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(wid, word, ids, sure) of words (wid, word): ids of the walk along likely pieces, null:
    unknown; not sure where the walk has a piece that the table does not know, or was not taken."""
    short = words.where(F.octet_length("word") <= CHUNK)
    known = pieces.where(F.length("piece") > 0).groupBy("piece", "inner").agg(F.max("id").cast("bigint").alias("id"))
    steps = short.mapInArrow(_walks(*piece_filter(pieces)), "wid long, at long, inner boolean, piece string") \
        .join(known.hint("merge"), ["piece", "inner"], "left")
    lost = F.col("piece") == ""
    walks = steps.groupBy("wid").agg(
        F.array_sort(F.collect_list(F.struct("at", "id"))).alias("steps"), F.max(lost).alias("lost"),
        F.max(~lost & F.col("id").isNull()).alias("wrong"))
    empty, ids = F.array().cast("array<bigint>"), F.transform("steps", lambda x: x["id"])
    return words.join(walks.hint("merge"), "wid", "left").select(
        "wid", "word", F.when(F.col("word") == "", empty).when(~F.col("lost"), ids).alias("ids"),
        F.coalesce((F.col("word") == "") | ~F.col("wrong"), F.lit(False)).alias("sure"))


def word_ids(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(src, tgt): the piece ids of each word of a column ``word`` of distinct words."""
    whole = pieces.where(~F.col("inner")).select(F.col("piece").alias("word"), F.col("id").cast("bigint").alias("id"))
    # staged: the numbers of words must stay what they are
    known = stage(words.join(whole.hint("merge"), "word", "left").withColumn("wid", F.monotonically_increasing_id()), "subword-words")
    open_words = stage(walked(known.where("id IS NULL").select("wid", "word"), pieces), "subword-walks")
    unknown = F.array(F.lit(UNKNOWN_ID).cast("bigint"))
    return known.where("id IS NOT NULL").select("word", F.array("id").alias("ids")) \
        .unionByName(open_words.where("sure").select("word", "ids")) \
        .unionByName(spelt_out(open_words.where("NOT sure").select("wid", "word"), pieces)) \
        .select(F.col("word").alias("src"), F.coalesce("ids", unknown).alias("tgt"))


def _flat(n: np.ndarray, words: pa.Array, ids: pa.Array) -> pa.Array:
    """The ids of all words of each row; null where one has none."""
    row = np.repeat(np.arange(len(n)), n)
    none = np.zeros(len(n), bool)
    none[row[np.asarray(ids.is_null())]] = True
    size = np.bincount(row, weights=np.asarray(pc.fill_null(pc.list_value_length(ids), 0)), minlength=len(n))
    return pa.ListArray.from_arrays(offsets(size.astype(np.int64)), ids.flatten(), mask=pa.array(none))


def subword_encode(df: DataFrame, pieces: DataFrame, key: str, token_array: str = "tokens",
                   out: str = "ids") -> DataFrame:
    """(key, ``out``): the piece ids of every token of a row, in order; no tokens or null
    give no ids."""
    words = df.select(F.explode(F.array_distinct(token_array)).alias("word")).distinct()
    said = look_up(df, [key], token_array, word_ids(words, pieces), by_key(_flat, True), ArrayType(LongType()))
    return said.select(key, F.coalesce("_said", F.array().cast("array<bigint>")).alias(out))
