"""Connected components of a distributed edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    ``edges`` has two columns of longs, a and b.  Each round points every larger
    neighbour of a node at the node's smallest neighbour, then every node's
    neighbours at its smallest smaller one; both keep connectivity, and stars of
    minima remain when nothing changes.  A round is staged in the shared folder,
    so lost executors cost one round.  Rounds grow with the logarithm of the
    longest path; ``max_rounds`` is an error, never a silent stop."""
    e = edges.toDF("a", "b").where("a <> b") \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage(e, "cc")
    seen = _digest(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a node go to its minimum
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(down.hint("merge"), "a")
        nxt = nxt.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
            .union(down.select("a", F.col("m").alias("b"))).distinct()
        e = stage(nxt, "cc")
        now = _digest(e)
        if now == seen:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        seen = now
    raise RuntimeError("components did not settle")


def _digest(e: DataFrame) -> tuple:
    """Number of edges and two sums over all of them: equal for equal edge sets."""
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")),
                       F.bit_xor(F.xxhash64("b", "a"))).first())
