"""Encode choices for a scorer.

* ``build_vocabulary``: frequency-ranked token ids.  Counting is a grouped
  aggregate (map-side combine); dense ids come from a distributed sort plus
  per-partition offsets, so the vocabulary is never gathered in one task.
* ``encode_tokens``: token -> id with unknown -> 1, order kept.  Only a row's
  distinct tokens of a block of rows meet the vocabulary.
* ``pad_truncate`` / ``attention_mask``: pure array expressions.
* ``split_segments``: separator positions -> zero-padded segments with an
  inverted mask; rows with the wrong separator count go to a rejects frame
  instead of failing the job.
* ``mean_pool``: per-dimension sums as a grouped aggregate; unmasked divides
  by the padded length (as the reference does), masked by the real count.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.columns import compute_once
from ..session import ensure_checkpoint_dir
from .joins import by_key, look_up, offsets

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_ID = 2


def dense_index(df: DataFrame, order: list[Column], out: str = "idx") -> DataFrame:
    """0-based position of each row in a total order, computed distributed:
    range-partitioned sort, per-partition counts, offsets from the (tiny)
    per-partition table, local position from the partition's row counter."""
    ensure_checkpoint_dir(df.sparkSession)
    s = df.sort(*order).withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_mid", F.monotonically_increasing_id())
    # reliable checkpoint: ids stay consistent between the two uses below even
    # if an executor is lost and partitions are recomputed
    s = s.checkpoint()
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition: a size bounded by the partition count
    return s.join(F.broadcast(offsets.select("_pid", "_off", "_m0")), "_pid") \
        .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0")) \
        .drop("_pid", "_mid", "_off", "_m0")


def build_vocabulary(tokens: DataFrame, token_array: str = "tokens") -> DataFrame:
    """(token, count, id): ids from 2 by descending count, then token."""
    counts = tokens.select(F.explode(token_array).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    ranked = dense_index(counts, [F.col("count").desc(), F.col("token").asc()], "_i")
    return ranked.select("token", "count", (F.col("_i") + FIRST_ID).alias("id"))


def _ids(n: np.ndarray, words: pa.Array, ids: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(offsets(n), pc.fill_null(ids, UNKNOWN_ID))


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, token_array: str = "tokens",
                  out: str = "ids") -> DataFrame:
    """Replace every token by its id (unknown -> 1), keeping token order; no
    tokens or null give no ids.  ``key`` identifies a row; ``df`` is read more than
    once, so stage tokens that cost work."""
    said = look_up(df, [key], token_array, vocab.select(
        F.col("token").alias("src"), F.col("id").cast("bigint").alias("tgt")), by_key(_ids, True), ArrayType(LongType()))
    return said.select(key, F.coalesce("_said", F.array().cast("array<bigint>")).alias(out))


def pad_truncate(arr, length: int, pad: int = PAD_ID) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(F.concat(F.slice(a, 1, length), F.array_repeat(F.lit(pad), length)),
                   1, length)


def attention_mask(arr, length: int) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return pad_truncate(F.transform(F.slice(a, 1, length), lambda x: F.lit(1)), length, 0)


def separator_positions(ids: str, sep: int) -> Column:
    """0-based positions of ``sep`` in the id array."""
    a = F.col(ids)
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: a[i] == sep)


def _pad_flag(n_tok: Column):
    # one-argument lambda: 0 on the segment's tokens, 1 on padding
    return lambda i: F.when(i <= n_tok, 0).otherwise(1)


def split_segments(df: DataFrame, ids: str = "ids", sep: int = 102, n_sep: int = 2,
                   key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Segments between [CLS] and each separator, each padded to the sequence
    length with zeros; masks are 0 on tokens and 1 on padding.  Returns
    ``(segments, rejects)``; a row whose separator count is not ``n_sep`` is a
    reject (the reference asserts)."""
    with_sep = compute_once(df, _seps=separator_positions(ids, sep))
    good = with_sep.where(F.size("_seps") == n_sep)
    rejects = with_sep.where(F.size("_seps") != n_sep) \
        .select(key, F.size("_seps").cast("bigint").alias("n_separators"))
    a, seps, length = F.col(ids), F.col("_seps"), F.size(F.col(ids))
    cols = []
    for j in range(n_sep):
        start = F.lit(0) if j == 0 else seps[j - 1]
        seg = F.slice(a, start + 2, seps[j] - start - 1)
        cols.append(F.slice(F.concat(seg, F.array_repeat(F.lit(0), length)), 1, length)
                    .alias(f"segment_{j}"))
        n_tok = seps[j] - start - 1
        cols.append(F.transform(F.sequence(F.lit(1), length), _pad_flag(n_tok))
                    .alias(f"mask_{j}"))
    return good.select(key, *cols), rejects


def mean_pool(df: DataFrame, key: str = "doc_id", vec: str = "embedding",
              masked: bool = True, padded_length: Column | int | None = None) -> DataFrame:
    """Per-dimension mean of a group's vectors, long form ``key, dim, value``.
    ``masked=False`` divides by ``padded_length`` (pads are zero vectors)."""
    long = df.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("dim", "x"))
    sums = long.groupBy(key, "dim").agg(F.sum("x").alias("_s"), F.count("x").alias("_n"))
    if masked:
        denom = F.col("_n")
    else:
        denom = padded_length if isinstance(padded_length, Column) else F.lit(padded_length)
    return sums.select(key, F.col("dim").cast("bigint").alias("dim"),
                       F.round(F.col("_s") / denom, 6).alias("value"))
