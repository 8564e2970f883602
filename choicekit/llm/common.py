"""Helpers shared by the operators of this subpackage.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z only.
``tokens`` finds them for a whole Arrow batch at once; ``pieces`` cuts a batch
into slices of bounded bytes first, so a batch of very long texts never has to
fit in memory in tokenised form.
"""
from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20          # text bytes tokenised at once in a task
FILTER_WORDS = 1 << 16         # rows of a document-id bit filter: 64 bits each, 512 KB in all


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: the lineage
    is cut by files every executor can read again after a loss."""
    path = shared_dir(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_words(text) -> F.Column:
    """Lower-cased A-Z of a text column (null: empty), other letters untouched."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def n_words(text) -> F.Column:
    """Number of words of a text column (null: 0)."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))) \
        .cast("long")


@dataclass
class Tokens:
    """Words of a slice: ``codes[offsets[i]:offsets[i+1]]`` index ``words`` for text i."""
    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array            # distinct words, binary


def tokens(text: pa.Array, lower: bool = True) -> Tokens:
    t = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    values = lists.flatten()
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    keep = np.asarray(pc.binary_length(values)) > 0 if len(values) else np.zeros(0, bool)
    if not keep.all():
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        values = values.filter(pa.array(keep))
    enc = values.cast(pa.binary()).dictionary_encode() if len(values) else \
        pa.array([], pa.binary()).dictionary_encode()
    return Tokens(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                  off.astype(np.int64), enc.dictionary)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding at most ``limit`` bytes of text, or one row."""
    for b in batches:
        give_back()
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        end, start, total = len(n), 0, np.cumsum(n)
        while start < end:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield b.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return this worker's freed memory to the system.  Spark reuses Python workers, so
    what one stage has freed would otherwise count on top of what the next one takes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread uint64 values over all 64 bits (vectorised, wraps)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _bit_no(h) -> F.Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(64)).cast("int")


def id_filter(ids: DataFrame, key: str) -> DataFrame:
    """(cell, bits): a bit per hash of ``key``; never more than FILTER_WORDS rows of
    two numbers whatever the input, so it may be broadcast."""
    h = F.xxhash64(F.col(key))
    return ids.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("cell"),
                      F.call_function("shiftleft", F.lit(1).cast("long"), _bit_no(h)).alias("b")) \
        .groupBy("cell").agg(F.bit_or("b").alias("bits"))


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be among ``ids``, rows whose ``key`` surely is not).
    The filter is a broadcast of fixed size; only possible members go on to an exact join."""
    h = F.xxhash64(F.col(key))
    bit = F.call_function("shiftrightunsigned", F.coalesce("__bits", F.lit(0).cast("long")),
                          _bit_no(h)).bitwiseAND(F.lit(1).cast("long"))
    cells = id_filter(ids, key).select(F.col("cell").alias("__cell"), F.col("bits").alias("__bits"))
    j = df.withColumn("__cell", F.pmod(h, F.lit(FILTER_WORDS))).join(F.broadcast(cells), "__cell", "left")
    maybe = j.where(bit == 1).drop("__cell", "__bits")
    never = j.where(bit == 0).drop("__cell", "__bits")
    return maybe, never


def lowest(df: DataFrame, by: list[str], order: list, k: int, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group: ranked in salted parts of the group first, so a
    group of any size is spread over tasks, then among those kept."""
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    some = df.withColumn("__salt", salt).withColumn(
        "__r", F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*order))).where(F.col("__r") <= k)
    return some.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))) \
        .where(F.col("__r") <= k).drop("__r", "__salt")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers when it was found by ``sys.path``
    alone.  With PYTHONPATH, an installed package or ``--py-files`` nothing is done."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if os.path.realpath(root) in seen or root.endswith(".zip") or getattr(sc, "_llm_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="llm-ship-"), "choicekit_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "choicekit")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._llm_shipped = True
