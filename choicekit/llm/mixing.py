"""Mixing sources to target weights (operator 9), DataFrame functions only.

A document's size is its number of words.  Each source's documents form one stream of
words, cut into n blocks of at most ``BLOCK`` words whose lengths differ by one at most.
The mix has as many words as all sources together; sources share it by weight, none above
``REPEAT`` times its own size.  A source has as many slots as its target holds blocks, and
one more for the words left over, which takes only the first of its block.  Output shards
hold ``SHARD`` slots.  In a shard a source gets the whole part of its expected slots, and
the slots left are drawn from the multinomial of the fractions.  What the draws give a
source beyond its slots is not dealt, what they leave is dealt over all shards, so every
source has exactly its slots.  The j-th slot of a source takes block perm(j mod n) of its
pass j div n, where perm is a keyed swap-or-not permutation of 0..n-1; a target holds at
most ``REPEAT`` passes.  Slots and pieces of documents meet by (source, block).

All draws are hashes of keys, so reruns agree.  Positions in a stream come from sums per
bucket of documents, so a source with a third of all rows is spread over many tasks.

Defined results: a null text or one without words has size 0 and is taken 0; a null
source is a source of its own, the last; repeated rows take their own places; an empty
table gives an empty mix; other columns are ignored by the plan.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stage

WEIGHTS = (5.0, 2.0, 1.0)
REPEAT = 3
BLOCK = 64            # words of a block
SHARD = 4096          # block slots of an output shard
BUCKET = 4096         # documents of a position bucket
CELLS = 4096          # guide cells for drawing a source
SUPER = 4096          # shards whose counts are summed together
ROUNDS = 24           # of the permutation
# a word with the white space behind it; the first also with what stands before it
PIECE = r"(^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"


@dataclass
class Plan:
    sizes: DataFrame      # si, p0, doc_id, h, size, source_size, target
    taken: DataFrame      # si, p0, epoch, shard, slot, first (word in the document), n (words)


def targets(sizes: DataFrame, weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """One row per source: source, si (its place), n_docs, source_size, target.

    Shares grow with the weights until a source reaches ``repeat`` times its size; the
    common level is found on running sums over sources in order of repeat * size / weight.
    The windows without a partition hold one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    per = per.withColumn("si", F.row_number().over(place) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("si", F.lit(len(weights))) + 1)
    per = per.withColumn("w", weight).withColumn("cap", (F.col("source_size") * repeat).cast("double"))
    asc = W.orderBy(F.col("cap") / F.col("w"), "si").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.sum("cap").over(asc) + F.col("cap"))
                         / (F.sum("w").over(every) - F.sum("w").over(asc) + F.col("w")))
    # the level at the first source that it doesn't fill
    open_ = F.when(F.col("level") < F.col("cap") / F.col("w"), F.col("cap") / F.col("w"))
    per = per.withColumn("level", F.min_by("level", open_).over(every))
    return per.select("source", "si", "n_docs", "source_size",
                      F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def permuted(x, n, key, rounds: int = ROUNDS):
    """Swap-or-not: a keyed pseudorandom permutation of 0..n-1, for any n."""
    def step(a, r):
        y = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("k")), n) - a, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(a, y)), F.lit(2)) == 1, y).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def plan(docs: DataFrame, weights=WEIGHTS, repeat: int = REPEAT, block: int = BLOCK,
         shard: int = SHARD, seed: int = 1) -> Plan:
    sizes = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                              F.xxhash64("text").alias("h")), "mix-sizes")
    src = stage(targets(sizes, weights, repeat), "mix-sources")
    # positions: buckets of documents, sums per bucket, then places inside a bucket
    s = sizes.join(src.withColumnRenamed("source", "s2"),
                   F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "source")
    nb = F.ceil(F.col("n_docs") / F.lit(BUCKET)).cast("long")
    s = s.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), nb))
    sums = s.groupBy("si", "bucket").agg(F.sum("size").alias("b"))
    before = sums.select("si", "bucket", (F.sum("b").over(
        W.partitionBy("si").orderBy("bucket")) - F.col("b")).alias("b0"))
    inside = W.partitionBy("si", "bucket").orderBy("doc_id", "h", "size") \
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.join(before, ["si", "bucket"]).withColumn(
        "p0", F.col("b0") + F.sum("size").over(inside) - F.col("size"))
    s = stage(s.select("si", "p0", "doc_id", "h", "size", "source_size", "target"), "mix-places")

    # how many slots of each shard a source gets
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    live = src.where("target > 0").withColumn("n", F.ceil(F.col("source_size") / block)) \
        .withColumn("mean", F.col("source_size") / F.col("n")) \
        .withColumn("own", F.floor(F.col("target") / F.col("mean") + 1e-9)) \
        .withColumn("rest", F.floor(F.col("target") - F.col("own") * F.col("mean") + 0.5)) \
        .withColumn("own", F.least(F.col("own") + (F.col("rest") > 0).cast("long"), F.col("n") * repeat)) \
        .where("own > 0").select(
        "si", "source_size", "n", "own", "rest", (F.col("own") / F.sum("own").over(every)).alias("p"),
        F.sum("own").over(every).alias("slots"))
    live = live.withColumn("whole", F.floor(F.col("p") * shard)) \
        .withColumn("frac", F.col("p") * shard - F.col("whole")) \
        .withColumn("left", F.lit(shard) - F.sum("whole").over(every)) \
        .withColumn("hi", F.sum("frac").over(W.orderBy("si").rowsBetween(W.unboundedPreceding, W.currentRow))
                    / F.greatest(F.sum("frac").over(every), F.lit(1e-300))) \
        .withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("si")), F.lit(0.0))) \
        .withColumn("shards", F.ceil(F.col("slots") / shard))
    live = stage(live, "mix-shares")
    # the last shard is cut short: its share of slots is cut alike
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    fill = F.least(F.lit(1.0), F.col("slots") / F.lit(shard) - F.col("shard"))
    base = live.select("si", "slots", "whole", number) \
        .select("si", "shard", F.floor(F.col("whole") * fill + 0.5).alias("k"))
    draws = live.agg(F.max("left").alias("left"), F.max("slots").alias("slots"),
                     F.max("shards").alias("shards")).where("left > 0") \
        .select("left", "slots", number) \
        .select("shard", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(
            F.col("left") * fill + 0.5)).cast("int"))).alias("d")) \
        .withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "d"), F.lit(1 << 40)) / F.lit(float(1 << 40))) \
        .withColumn("cell", F.floor(F.col("u") * CELLS))
    guide = live.where("hi > lo").select("si", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    drawn = draws.join(guide, "cell").where("u >= lo AND u < hi").groupBy("si", "shard") \
        .agg(F.count("*").alias("k"))
    counts = base.union(drawn).groupBy("si", "shard").agg(F.sum("k").alias("k")) \
        .withColumn("super", F.floor(F.col("shard") / SUPER))
    over = counts.groupBy("si", "super").agg(F.sum("k").alias("sk"))
    over = over.select("si", "super", (F.sum("sk").over(W.partitionBy("si").orderBy("super"))
                                       - F.col("sk")).alias("j0"))
    counts = counts.join(over, ["si", "super"]).withColumn("j0", F.col("j0") + F.sum("k").over(
        W.partitionBy("si", "super").orderBy("shard")) - F.col("k"))
    # exactly the source's slots: the draws up to them, and what they leave over all shards
    drawn = counts.groupBy("si").agg(F.sum("k").alias("drawn"))
    own = live.select("si", "n", "own", "rest", "shards")
    dealt = counts.join(own, "si").select(
        "si", "shard", "n", "own", "rest", F.col("j0").alias("a"), F.least(F.col("j0") + F.col("k"), "own").alias("z"))
    left = own.join(drawn, "si", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < own") \
        .select("*", F.explode(F.sequence(F.col("drawn"), F.col("own") - 1, F.lit(shard).cast("long"))).alias("a")) \
        .select("si", F.pmod(F.xxhash64(F.lit(seed), "si", "a"), F.col("shards")).alias("shard"), "n", "own", "rest",
                "a", F.least(F.col("a") + shard, "own").alias("z"))
    # a few rows make all slots: deal them out before
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = dealt.union(left).where("a < z").repartition(parts, "si", "shard") \
        .select("si", "shard", "n", "own", "rest", F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("slot")) \
        .withColumn("epoch", F.floor(F.col("slot") / F.col("n"))) \
        .withColumn("key", F.xxhash64(F.lit(seed), "si", "epoch")) \
        .select("si", "shard", "slot", "epoch",
                F.when((F.col("slot") == F.col("own") - 1) & (F.col("rest") > 0), F.col("rest")).alias("only"),
                permuted(F.pmod("slot", F.col("n")), F.col("n"), F.col("key")).alias("block"))
    # the first `long` blocks of a source have a word more than the others
    n = F.ceil(F.col("source_size") / block)
    w = F.floor(F.col("source_size") / F.col("__n"))
    here = s.where("size > 0").withColumn("__n", n).withColumn("__w", w) \
        .withColumn("__long", F.col("source_size") - F.col("__n") * F.col("__w"))
    edge = F.col("__long") * (F.col("__w") + 1)

    def block_of(p):
        return F.when(p < edge, F.floor(p / (F.col("__w") + 1))).otherwise(
            F.col("__long") + F.floor((p - edge) / F.col("__w")))

    begin = F.col("block") * F.col("__w") + F.least("block", "__long")
    end = begin + F.col("__w") + (F.col("block") < F.col("__long")).cast("long")
    pieces = here.select("si", "p0", "size", "__w", "__long", F.explode(F.sequence(
        block_of(F.col("p0")), block_of(F.col("p0") + F.col("size") - 1))).alias("block")) \
        .withColumn("first", F.greatest(F.lit(0).cast("long"), begin - F.col("p0"))) \
        .withColumn("n", F.least("size", end - F.col("p0")) - F.col("first")) \
        .withColumn("at", F.col("p0") + F.col("first") - begin) \
        .select("si", "block", "p0", "first", "n", "at")
    # slots come from a few exploded rows, so their estimated size says nothing: no broadcast
    n = F.least(F.col("n"), F.coalesce(F.col("only") - F.col("at"), F.col("n")))
    taken = slots.hint("merge").join(pieces, ["si", "block"]).withColumn("n", n).where("n > 0") \
        .select("si", "p0", "epoch", "shard", "slot", "first", "n")
    return Plan(s, taken)


def taken_words(p: Plan) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of the documents."""
    t = p.taken.groupBy("si", "p0").agg(F.sum("n").alias("taken"))
    some = p.sizes.where("size > 0").join(t, ["si", "p0"], "left")
    none = p.sizes.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target",
                                         F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per document and pass, holding the words taken of it in
    that pass, in order, with their white space; texts taken whole stay as they are."""
    p = plan(docs, **options)
    runs = p.taken.groupBy("si", "p0", "epoch").agg(
        F.sum("n").alias("words"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("parts"))
    # own names: the documents may have columns of any other
    runs = p.sizes.where("size > 0").join(runs, ["si", "p0"]).select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("size").alias("__size"),
        F.col("words").alias("__taken"), F.col("parts").alias("__parts"))
    text = docs.withColumn("__h", F.xxhash64("text")).withColumnRenamed("doc_id", "__id") \
        .dropDuplicates(["__id", "__h"])
    words = F.regexp_extract_all(F.col("text"), F.lit(PIECE), F.lit(1))
    j = text.join(runs, (text["__id"].eqNullSafe(runs["__id"])) & (text["__h"] == runs["__h"])) \
        .drop(runs["__id"]).drop(runs["__h"])
    cut = F.when(F.col("__taken") == F.col("__size"), F.col("text")).otherwise(F.array_join(F.transform(
        "__parts", lambda x: F.array_join(F.slice("__words", (x["first"] + 1).cast("int"),
                                                  x["n"].cast("int")), "")), ""))
    j = j.withColumn("__words", F.when(F.col("__taken") < F.col("__size"), words)).withColumn("text", cut)
    j = j.withColumnRenamed("__id", "doc_id")
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)
