"""Cosine k-means inside every group with restarts.

All groups and all restarts move together.  A group's points lie in parts of about ``PART``,
and every pass brings each part together with the centres of its group, of all restarts, so a
pass is one job whatever the number of restarts, and a hot group is spread over its parts.

* Seeds: k-means++.  A restart's next seed is drawn by the distance to its seeds so far, as
  the winner of an exponential race of hashed draws, so parts need only send their winner.
* Steps: parts return sums per (restart, cluster); a centre is the direction of its sum, an
  empty cluster keeps its centre.  A restart whose centres moved by at most ``tolerance`` rests.
* The restart with the highest sum of similarities stays; the lowest number wins ties.

``report`` tells each restart's objective and whether it came to rest within ``max_iter``
steps, so a stop by the limit shows.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import stage

PART = 4_096           # points of a part, about


def _unit(v: Column) -> Column:
    """The vector's direction; a zero vector stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def _points(df: DataFrame, key: str, item: str, vec: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(points in parts, the number of parts of each group)."""
    valid = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    parts = stage(valid.groupBy(F.col(key).alias("k")).agg(
        F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "kmeans-parts")
    rows = valid.select(F.col(key).alias("k"), F.col(item).alias("item"),
                        F.xxhash64(F.col(item), F.lit(seed)).alias("h"),
                        _unit(F.col(vec).cast("array<double>")).alias("x"))
    return stage(rows.join(parts, "k").withColumn("part", F.pmod("h", F.col("parts")).cast("int")).drop("parts"),
                 "kmeans-points"), parts


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return np.asarray(t[column].combine_chunks().flatten()).reshape(len(t), -1)


def _pass(points: DataFrame, parts: DataFrame, centres: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(points, centres)`` of every part with the centres of its group."""
    to = centres.join(parts, "k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    ddl = f"k {points.schema['k'].dataType.simpleString()}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(key: tuple, p: pa.Table, c: pa.Table) -> pa.Table:
        out = work(p, c) if len(p) else None
        if not out:
            return arrow.empty_table()
        n = len(next(iter(out.values())))
        return pa.table({"k": pa.array([key[0].as_py()] * n), **out}).select(arrow.names).cast(arrow)

    return points.groupBy("k", "part").cogroup(to.groupBy("k", "part")).applyInArrow(run, ddl)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in (0, 1) of hashes and a number."""
    x = h.astype(np.int64).view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def _seed_pass(restarts: int, place: int):
    def work(p: pa.Table, c: pa.Table) -> dict:
        x, h = _matrix(p, "x"), np.asarray(p["h"])
        own = np.asarray(c["restart"]) if len(c) else np.zeros(0, int)
        sims = x @ _matrix(c, "centre").T if len(c) else np.zeros((len(x), 0))
        got = []
        for r in range(restarts):
            mine = sims[:, own == r]
            if place and not mine.shape[1]:
                continue
            far = 1 - mine.max(axis=1) if place else np.ones(len(x))
            far = np.where(far > 1e-12, far, 0)
            with np.errstate(divide="ignore"):
                race = -np.log(_mixed(h, r * 1009 + place)) / far
            i = int(np.lexsort((h, race))[0])
            if np.isfinite(race[i]):
                got.append((r, float(race[i]), int(h[i]), x[i].tolist()))
        return {"restart": pa.array([g[0] for g in got], pa.int32()), "race": pa.array([g[1] for g in got], pa.float64()),
                "h": pa.array([g[2] for g in got], pa.int64()),
                "centre": pa.array([g[3] for g in got], pa.list_(pa.float64()))}
    return work


def _nearest(p: pa.Table, c: pa.Table, live_only: bool):
    """Of every restart: (restart, its cluster numbers, nearest of them and similarity per point)."""
    x, centre = _matrix(p, "x"), _matrix(c, "centre")
    restart, cluster = np.asarray(c["restart"]), np.asarray(c["cluster"])
    live = np.asarray(c["live"].combine_chunks())
    for r in np.unique(restart):
        rows = np.flatnonzero(restart == r)
        if live_only and not live[rows[0]]:
            continue
        rows = rows[np.argsort(cluster[rows])]
        sims = x @ centre[rows].T
        near = np.argmax(np.round(sims, 9), axis=1)          # the lowest cluster wins ties
        yield int(r), cluster[rows], near, sims[np.arange(len(x)), near], x


def _sum_pass(live_only: bool):
    def work(p: pa.Table, c: pa.Table) -> dict | None:
        if not len(c):
            return None
        out = {"restart": [], "cluster": [], "n": [], "sim": [], "total": []}
        for r, cluster, near, sim, x in _nearest(p, c, live_only):
            for j in np.unique(near):
                of = near == j
                for name, v in zip(out, (r, int(cluster[j]), int(of.sum()), float(sim[of].sum()),
                                         x[of].sum(axis=0).tolist()), strict=True):
                    out[name].append(v)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}
    return work


_SUMS = "restart int, cluster int, n bigint, sim double, total array<double>"


def kmeans_restarts(df: DataFrame, k: int, restarts: int = 25, max_iter: int = 25, key: str = "doc_id",
                    item: str = "vec_id", vec: str = "embedding", seed: int = 7,
                    tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(members, report).  members: key, item, cluster, centre_sim, restart; report: key, restart,
    objective (sum of similarities), converged, kept.  Rows with a null key or vector take no
    part; a group has at most as many clusters as distinct directions."""
    points, parts = _points(df, key, item, vec, seed)
    kind = points.schema["k"].dataType.simpleString()
    centres = df.sparkSession.createDataFrame([], f"k {kind}, restart int, cluster int, centre array<double>, live boolean")
    for place in range(k):
        won = _pass(points, parts, centres, _seed_pass(restarts, place),
                    "restart int, race double, h bigint, centre array<double>")
        new = won.groupBy("k", "restart").agg(F.min_by("centre", F.struct("race", "h")).alias("centre")).select(
            "k", "restart", F.lit(place).alias("cluster"), "centre", F.lit(True).alias("live"))
        centres = stage(centres.unionByName(new), "kmeans-seeds")
    dot = F.aggregate(F.zip_with("centre", "new", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    for _ in range(max_iter):
        sums = _pass(points, parts, centres, _sum_pass(True), _SUMS).groupBy("k", "restart", "cluster").agg(
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
        moved = centres.join(sums, ["k", "restart", "cluster"], "left").withColumn(
            "new", F.when(F.col("total").isNull(), F.col("centre")).otherwise(_unit(F.col("total"))))
        # k rows of a restart: a bounded window
        rest = F.max((1 - dot > tolerance).cast("int")).over(Window.partitionBy("k", "restart")) == 0
        centres = stage(moved.withColumn("rest", rest).select(
            "k", "restart", "cluster", F.col("new").alias("centre"), (F.col("live") & ~F.col("rest")).alias("live")),
            "kmeans-centres")
        if centres.where("live").isEmpty():
            break
    objective = _pass(points, parts, centres, _sum_pass(False), _SUMS).groupBy("k", "restart").agg(
        F.round(F.sum("sim"), 9).alias("objective"))
    done = centres.groupBy("k", "restart").agg((~F.max("live")).alias("converged"))
    report = objective.join(done, ["k", "restart"])
    best = report.groupBy("k").agg(F.max_by("restart", F.struct("objective", -F.col("restart"))).alias("best"))
    report = stage(report.join(best, "k").withColumn("kept", F.col("restart") == F.col("best")).drop("best"), "kmeans-report")
    kept = centres.join(report.where("kept").select("k", "restart"), ["k", "restart"], "left_semi")

    def assign(p: pa.Table, c: pa.Table) -> dict | None:
        if not len(c):
            return None
        r, cluster, near, sim, _ = next(_nearest(p, c, False))
        return {"item": p["item"].combine_chunks(), "cluster": pa.array(cluster[near].astype(np.int64)), "centre_sim": pa.array(sim),
                "restart": pa.array([r] * len(sim), pa.int32())}

    members = _pass(points, parts, kept, assign, f"item {points.schema['item'].dataType.simpleString()}, "
                                                 "cluster bigint, centre_sim double, restart int")
    return (members.withColumnRenamed("k", key).withColumnRenamed("item", item),
            report.withColumnRenamed("k", key))
