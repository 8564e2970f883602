"""Hard-negative mining with a GNAT-style tree (operator 11).

Vectors become integers, floor(256 x).  With one more coordinate, sqrt(M^2 - |x|^2) for the
longest vector's norm M, all lie on one sphere, so an inner product with an anchor is a
distance to it and a window of scores is an annulus.

The tree has ``FAN`` split points a node, chosen far apart from a bounded sample, and parts
its vectors by the nearest one, along hyperplanes.  Every split point keeps the range of
its distances to each sibling's subtree; these ranges come from all rows.  A bottom node is
cut into leaves of at most ``LEAF`` vectors by distance to its split point, so leaves stay
of one size as the table grows, and a leaf too keeps its range to each split point above.
A query drops a sibling, then a leaf, when for some split point the sum or difference of
distances leaves the annulus outside; what is left is scored exactly.

Positives are searched first, then the negatives of each (anchor, positive) window.  Each
search first visits the leaf that the anchor itself is in; what it finds there narrows the
annulus of the full visit.  Leaves and queries meet in parts of bounded size.

Equal vectors of a label are searched once, with the smallest ids they stand for (no larger
id can be among the first), and anchors of equal vector and label share one search.

Defined results: rows without vec_id, with a null label or vector, or with a null or
non-finite component take no part, nor do integers beyond 2^26 in absolute value, whose
scores would not fit; shorter vectors end in zeros; rows repeated whole count once; other
rows of a vec_id are rows of their own, but no positives of each other; an empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, stage

SAMPLE = 16_384            # distinct vectors the split points are chosen from, at most
FAN = 16                   # split points of a node
SMALL = 256                # sample vectors of a node that is not parted further
LEVELS = 2
LEAF = 1_024               # vectors of a leaf, at most
QUERIES = 2_048            # queries that meet a leaf in one task, about
ROUTED = 128               # queries routed at once
POSITIVES, NEGATIVES = 5, 5
LIMIT = 1 << 26            # of a component, in absolute value
HOT = 256                  # share of the anchors, as 1 / HOT, from which a vector is salted
SALTS = 32


@dataclass
class Node:
    points: np.ndarray                 # split points, with the extra coordinate
    children: list                     # number of the child node, or None: a bottom node
    bottom: list                       # number of the bottom node, or None


@dataclass
class Tree:
    nodes: list[Node]
    n_bottom: int
    norm: float                        # M
    width: int                         # components of a vector
    low: np.ndarray | None = None      # [node, split, sibling] distances
    high: np.ndarray | None = None

    @property
    def slack(self) -> float:
        return 1e-6 * (self.norm + 1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm ** 2 - np.einsum("ij,ij->i", x, x), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def far_apart(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows of a small random choice of x, each the farthest from those before it."""
    x = x[np.sort(rng.choice(len(x), min(len(x), 3 * k), replace=False))]
    near = distances(x, x[:1])[:, 0]
    picked = [0]
    while len(picked) < min(k, len(x)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        picked.append(i)
        near = np.minimum(near, distances(x, x[i:i + 1])[:, 0])
    return x[picked]


def build(sample: np.ndarray, norm: float, width: int) -> Tree:
    """The split points, from a bounded sample; without one, a single point at the origin."""
    tree = Tree([], 0, norm, width)
    rng = np.random.default_rng(0)

    def grow(x: np.ndarray, level: int) -> int:
        me = len(tree.nodes)
        node = Node(far_apart(x, FAN, rng), [], [])
        tree.nodes.append(node)
        of = distances(x, node.points).argmin(axis=1)
        for j in range(len(node.points)):
            mine = x[of == j]
            if level + 1 < LEVELS and len(mine) > SMALL:
                node.children.append(grow(mine, level + 1))
                node.bottom.append(None)
            else:
                node.children.append(None)
                node.bottom.append(tree.n_bottom)
                tree.n_bottom += 1
        return me

    grow(tree.lift(sample if len(sample) else np.zeros((1, width))), 0)
    return tree


def descend(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Bottom node of each vector, its distances to the split points on the way (LEVELS x
    FAN, infinity where there is none), and per visited node (node, rows, nearest, distances)."""
    bottom = np.zeros(len(x), np.int64)
    path = np.full((len(x), LEVELS * FAN), np.inf)
    seen, todo = [], [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, level = todo.pop()
        node = tree.nodes[at]
        d = distances(x[rows], node.points)
        near = d.argmin(axis=1)
        path[rows, level * FAN:level * FAN + d.shape[1]] = d
        seen.append((at, rows, near, d))
        for j, (child, leaf) in enumerate(zip(node.children, node.bottom, strict=True)):
            mine = rows[near == j]
            if child is None:
                bottom[mine] = leaf
            elif len(mine):
                todo.append((child, mine, level + 1))
    return bottom, path, seen


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as float64 (their integers are exact)."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), width)


def lists(a: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(a.ravel()))


def rows_of(df: DataFrame) -> DataFrame:
    """vec_id, label (as shifted for every seventh row), ints: the rows that take part."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) < LIMIT))
    label = F.col("label").cast("long")
    return df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        x.cast("array<int>").alias("ints"))


def fit(vectors: DataFrame) -> Tree:
    """Split points from the ``SAMPLE`` vectors of lowest key (a hash, so a random choice),
    ranges from all."""
    norm2, width, n = vectors.agg(F.max("norm2"), F.max(F.size("ints")), F.count("*")).first()
    share = F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("double") / 2.0 ** 48
    low = vectors.where(share <= 2.0 * SAMPLE / max(n, 1))        # sends few rows to be sorted
    width = int(width or 1)
    sample = matrix(low.orderBy("key").limit(SAMPLE).select("ints").toArrow()["ints"].combine_chunks(), width)
    tree = build(sample, float(np.sqrt(norm2 or 0)), width)
    shape = (len(tree.nodes), FAN, FAN)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for b in batches:
            for at, _, near, d in descend(tree, tree.lift(matrix(b.column("ints"), width)))[2]:
                for j in np.unique(near):
                    low[at, :d.shape[1], j] = np.minimum(low[at, :d.shape[1], j], d[near == j].min(axis=0))
                    high[at, :d.shape[1], j] = np.maximum(high[at, :d.shape[1], j], d[near == j].max(axis=0))
        at = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(low.ravel()[at]), pa.array(high.ravel()[at])],
                                         ["at", "low", "high"])

    # nodes x FAN x FAN rows whatever the table
    got = vectors.select("ints").mapInArrow(ranges, "at long, low double, high double") \
        .groupBy("at").agg(F.min("low"), F.max("high")).collect()
    tree.low, tree.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    for at, low, high in got:
        tree.low.ravel()[at], tree.high.ravel()[at] = low, high
    return tree


def leaves(vectors: DataFrame, tree: Tree, size: int) -> DataFrame:
    """A row per leaf: bottom, leaf (a number), n, low and high (ranges of the distances to
    the split points above it), its vectors, labels and ids, and the keys of those asked for."""
    width = tree.width

    def assign(batches):
        for b in batches:
            x = tree.lift(matrix(b.column("ints"), width))
            bottom, path, _ = descend(tree, x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bottom), pa.array(path.min(axis=1)), lists(path),
                 b.column("ints"), b.column("label"), b.column("ids"), b.column("asked")],
                ["bottom", "near", "path", "ints", "label", "ids", "asked"])

    def cut(batches):
        held: list[pa.RecordBatch] = []

        def rows(t: pa.Table):
            bottom = np.asarray(t["bottom"])
            edges = np.flatnonzero(np.concatenate([[True], bottom[1:] != bottom[:-1]]))
            for a, z in zip(edges, [*edges[1:], len(bottom)], strict=True):
                for i in range(a, z, size):
                    part = t.slice(i, min(size, z - i)).combine_chunks()
                    path = np.asarray(part["path"].combine_chunks().flatten()).reshape(len(part), -1)
                    ints = np.asarray(part["ints"].combine_chunks().flatten()).astype("<i4")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bottom[a])]), pa.array([len(part)], pa.int32()),
                         pa.array([path.min(axis=0).tolist()], pa.list_(pa.float64())),
                         pa.array([path.max(axis=0).tolist()], pa.list_(pa.float64())),
                         pa.array([ints.tobytes()], pa.binary()),
                         pa.array([part["label"].to_pylist()], pa.list_(pa.int64())),
                         pa.array([part["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
                         pa.array([part["asked"].drop_null().to_pylist()], pa.list_(pa.binary()))],
                        ["bottom", "n", "low", "high", "ints", "labels", "ids", "asked"])

        for b in batches:
            held.append(b)
            t = pa.Table.from_batches(held)
            # whole leaves of the bottom node that goes on, and all of those before it
            bottom = np.asarray(t["bottom"])
            start = int(np.searchsorted(bottom, bottom[-1])) if len(bottom) else 0
            keep = len(t) - (len(t) - start) % size
            if keep:
                yield from rows(t.slice(0, keep))
            held = t.slice(keep).to_batches()
        if held:
            yield from rows(pa.Table.from_batches(held))

    placed = vectors.mapInArrow(assign, "bottom long, near double, path array<double>, ints array<int>, "
                                        "label long, ids array<long>, asked binary")
    parts = placed.repartitionByRange("bottom", "near").sortWithinPartitions("bottom", "near").mapInArrow(
        cut, "bottom long, n int, low array<double>, high array<double>, ints binary, labels array<long>, "
             "ids array<array<long>>, asked array<binary>")
    return parts.withColumn("leaf", F.monotonically_increasing_id())


def survivors(queries: DataFrame, tree: Tree, index: DataFrame) -> DataFrame:
    """(key, leaf) of every leaf that an annulus of the query meets.  ``windows`` holds the
    scores from ``lo`` to ``hi`` that a query asks for."""
    width = tree.width

    def route(batches):
        for b in (b.slice(i, ROUTED) for b in batches for i in range(0, b.num_rows, ROUTED)):
            x = matrix(b.column("ints"), width)
            norm2 = np.einsum("ij,ij->i", x, x)
            w = b.column("windows").to_pylist()
            # widest annulus of all windows: siblings outside it hold nothing wanted
            lo = np.array([min(v["lo"] for v in ws) for ws in w], np.float64)
            hi = np.array([max(v["hi"] for v in ws) for ws in w], np.float64)
            far = np.sqrt(np.maximum(norm2 + tree.norm ** 2 - 2 * lo, 0)) + tree.slack
            near = np.sqrt(np.maximum(norm2 + tree.norm ** 2 - 2 * hi, 0)) - tree.slack
            x = np.hstack([x, np.zeros((len(x), 1))])
            who, where, path = [], [], []
            todo = [(0, np.arange(len(x)), 0, np.full((len(x), LEVELS * FAN), np.inf))]
            while todo:
                at, rows, level, so_far = todo.pop()
                node = tree.nodes[at]
                d = distances(x[rows], node.points)
                so_far = so_far.copy()
                so_far[:, level * FAN:level * FAN + d.shape[1]] = d
                for j, (child, leaf) in enumerate(zip(node.children, node.bottom, strict=True)):
                    low, high = tree.low[at, :d.shape[1], j], tree.high[at, :d.shape[1], j]
                    if not np.isfinite(low).all():
                        continue                      # no row there
                    below = np.maximum(d - high, low - d).max(axis=1)
                    above = (d + high).min(axis=1)
                    meet = (below <= far[rows]) & (above >= near[rows])
                    if child is None:
                        who.append(rows[meet])
                        where.append(np.full(meet.sum(), leaf))
                        path.append(so_far[meet])
                    elif meet.any():
                        todo.append((child, rows[meet], level + 1, so_far[meet]))
            who = np.concatenate(who) if who else np.zeros(0, np.int64)
            if not len(who):
                continue
            out = b.take(pa.array(who))
            path = np.concatenate(path)
            path[~np.isfinite(path)] = np.nan
            yield pa.RecordBatch.from_arrays(
                [out.column("key"), out.column("windows"), pa.array(np.concatenate(where)), pa.array(norm2[who]),
                 lists(path)], ["key", "windows", "bottom", "norm2", "path"])
            give_back()

    routed = queries.select("key", "ints", "windows").mapInArrow(
        route, "key binary, windows array<struct<w:int,lo:long,hi:long>>, bottom long, norm2 double, "
               "path array<double>")
    joined = routed.join(index.select("bottom", "leaf", "low", "high").hint("merge"), "bottom")
    # NaN marks levels that do not exist; it is dropped from both bounds
    ok = lambda v: F.when(F.isnan(v), F.lit(None)).otherwise(v)
    steps = F.zip_with("low", "high", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    below = F.array_max(F.zip_with("path", steps, lambda d, r: ok(F.greatest(d - r["hi"], r["lo"] - d))))
    above = F.array_min(F.zip_with("path", F.col("high"), lambda d, h: ok(d + h)))
    m2 = tree.norm ** 2
    reach = lambda score: F.sqrt(F.greatest(F.col("norm2") + F.lit(m2) - 2.0 * score, F.lit(0.0)))
    meets = F.exists("windows", lambda w: (F.col("below") <= reach(w["lo"].cast("double")) + tree.slack)
                     & (F.col("above") >= reach(w["hi"].cast("double")) - tree.slack))
    return joined.withColumn("below", below).withColumn("above", above).where(meets) \
        .select("key", "leaf")


def visit(queries: DataFrame, pairs: DataFrame, index: DataFrame, tree: Tree, k: int, same: bool) -> DataFrame:
    """(key, w, score, vec_id, rank): the first k of each window of each query among the
    leaves it visits (``pairs``), of its own label (``same``) or of the others."""
    width = tree.width
    # each leaf meets its queries in parts; a leaf goes to as many as it has
    n_parts = pairs.groupBy("leaf").agg((F.floor(F.count("*") / QUERIES) + 1).cast("int").alias("parts"))
    # merge joins: the driver builds no broadcast of tables that grow
    n_parts = n_parts.hint("merge")
    left = pairs.join(n_parts, "leaf").join(queries.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    right = index.join(n_parts, "leaf").select(
        "leaf", "ints", "labels", "ids", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def score(key: tuple, q: pa.Table, leaf: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(q) and len(leaf):
            x = np.frombuffer(leaf["ints"][0].as_py(), "<i4").astype(np.float64).reshape(-1, width)
            labels = np.array(leaf["labels"][0].as_py(), np.int64)
            ids = leaf["ids"][0].as_py()
            first = np.array([i[0] for i in ids], np.int64)
            big = np.abs(x).max() if x.size else 0
            keys, mine = q["key"].to_pylist(), np.asarray(q["label"])
            windows = q["windows"].to_pylist()
            y = matrix(q["ints"].combine_chunks(), width)
            exact = big * (np.abs(y).max() if y.size else 0) * width < 2 ** 53
            for a in range(0, len(y), 512):
                if exact:
                    s = (y[a:a + 512] @ x.T).astype(np.int64)
                else:
                    s = y[a:a + 512].astype(np.int64) @ x.astype(np.int64).T
                for i, row in enumerate(s, a):
                    fits = labels == mine[i] if same else labels != mine[i]
                    for w in windows[i]:
                        at = np.flatnonzero(fits & (row >= w["lo"]) & (row <= w["hi"]))
                        if len(at) > k:               # a vector of lower rank adds nothing
                            at = at[np.lexsort((first[at], -row[at]))[:k]]
                        got = sorted(((-int(row[j]), v) for j in at for v in ids[j]))[:k]
                        out[0] += [keys[i]] * len(got)
                        out[1] += [w["w"]] * len(got)
                        out[2] += [-g[0] for g in got]
                        out[3] += [g[1] for g in got]
        give_back()
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()),
                         pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                        ["key", "w", "score", "vec_id"])

    found = left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(
        score, "key binary, w int, score long, vec_id long")
    rank = F.row_number().over(W.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, tree: Tree, index: DataFrame, k: int, same: bool, name: str) -> DataFrame:
    """The first k of every window, exactly: a visit of the query's own leaf, then of all
    leaves that the annuli narrowed by it still meet."""
    own = stage(index.select(F.explode("asked").alias("key"), "leaf"), f"{name}-own")
    found = visit(queries, own, index, tree, k, same)
    reached = stage(found.where(F.col("rank") == k).groupBy("key").agg(
        F.collect_list(F.struct("w", "score")).alias("reached")), f"{name}-reached")
    narrowed = stage(queries.join(reached.hint("merge"), "key", "left").withColumn("windows", F.transform(
        "windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], F.coalesce(
            F.try_element_at(F.filter("reached", lambda r: r["w"] == w["w"]), F.lit(1))["score"], w["lo"])).alias("lo"),
            w["hi"].alias("hi")))).drop("reached"), f"{name}-narrowed")
    left = stage(survivors(narrowed, tree, index), f"{name}-left")
    return stage(visit(narrowed, left, index, tree, k, same), name)


def mine(df: DataFrame, anchors: int = 100, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = rows_of(df)
    width = F.lit(rows.agg(F.max(F.size("ints"))).first()[0] or 1)
    padded = rows.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0), width - F.size("ints"))))
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("ints").cast("array<string>")), 256))
    rows = stage(padded.withColumn("key", key), "negatives-rows")

    # a row per (vector, label) with the smallest ids: one may be the anchor, POSITIVES others
    k = POSITIVES + 1
    ids = rows.select("key", "vec_id").distinct()
    few = ids.withColumn("o", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("o") <= k) \
        .groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    square = F.aggregate("ints", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)
    asked = stage(ids.where(F.col("vec_id") % anchors == 0), "negatives-anchors")
    want = asked.select("key").distinct().withColumn("asked", F.col("key")).hint("merge")
    vectors = stage(rows.dropDuplicates(["key"]).select("key", "label", "ints").join(few.hint("merge"), "key")
                    .join(want, "key", "left").withColumn("norm2", square), "negatives-vectors")
    tree = fit(vectors)
    index = stage(leaves(vectors, tree, leaf), "negatives-leaves")
    low, high = -(1 << 62), 1 << 62
    one = F.array(F.struct(F.lit(0).alias("w"), F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi")))
    queries = stage(vectors.where("asked IS NOT NULL").select("key", "label", "ints").withColumn("windows", one),
                    "negatives-queries")
    positives = nearest(queries, tree, index, k, True, "negatives-positives")

    # a window per positive score: 80 p <= 100 n <= 100 p, so ceil(4 p / 5) <= n <= p
    window = positives.where("score >= 0").groupBy("key").agg(F.array_sort(F.collect_set("score")).alias("p"))
    windows = window.select("key", F.expr(
        "transform(p, (v, i) -> named_struct('w', int(i), 'lo', v - v div 5, 'hi', v))").alias("windows"))
    wanted = stage(queries.drop("windows").join(windows.hint("merge"), "key"), "negatives-windows")
    negatives = nearest(wanted, tree, index, NEGATIVES, False, "negatives-found")
    scores = wanted.select("key", F.inline("windows")).select("key", "w", F.col("hi").alias("positive_score"))
    negatives = negatives.join(scores.hint("merge"), ["key", "w"]).groupBy("key", "positive_score").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives"))
    answer = positives.select("key", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")) \
        .join(negatives.hint("merge"), ["key", "positive_score"], "left").groupBy("key").agg(F.array_sort(F.collect_list(
            F.struct("rank", "positive_id", "positive_score", "negatives"))).alias("positives"))

    # at most HOT vectors hold one in HOT of the anchors or more; their anchors are salted
    total = asked.count()
    hot = stage(asked.groupBy("key").count().where(F.col("count") * HOT > total).select("key", F.lit(True).alias("hot")),
                "negatives-hot")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    left = asked.join(F.broadcast(hot), "key", "left").withColumn("salt", salt)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = answer.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(salts)).drop("hot")
    others = F.slice(F.filter("positives", lambda p: p["positive_id"] != F.col("vec_id")), 1, POSITIVES)
    return left.join(right.hint("merge"), ["key", "salt"]).select(F.col("vec_id").alias("anchor_id"), F.inline(others)).select(
        "anchor_id", "positive_id", "positive_score", F.inline("negatives")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
