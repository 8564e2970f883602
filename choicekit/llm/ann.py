"""Approximate nearest neighbours by a hierarchical k-means tree (operator 3).

The tree is fitted on at most ``SAMPLE`` vectors: k-means into branches, each branch into
leaves.  Every distinct vector is assigned to a leaf.  A query walks the tree best bin
first: a priority queue holds branches and leaves by inner product with their centres, and
leaves are visited until the calibrated number is reached.  That number is the smallest at
which sample queries find ``RECALL`` of their exact nearest among the sample.

Branches are shared out in parts of bounded size, and so are the queries that visit them;
a task scores one part of a branch against one part of its queries in double precision.
Copies of a vector are searched once, with the ``k + 1`` smallest ids they stand for (no
larger id can be in a result), so a vector that holds a third of all rows is one candidate.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows without vec_id, take no part, nor do vectors of another length than the commonest;
rows repeated whole count once; fewer candidates than k give them all; ties go to the
smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

SAMPLE = 16_384           # vectors the tree is fitted and calibrated on at most
SAMPLE_BYTES = 64 << 20   # and their size
LEAF = 96                 # sample vectors of a leaf, about
FAN = 16                  # leaves of a branch, about
RECALL = 0.97             # aimed at on the sample
PART = 4_096              # vectors, or queries, of a part


def kmeans(x: np.ndarray, k: int, rng, steps: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c[np.bincount(nearest(x, c), minlength=len(c)) > 0]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i:i + 8192] @ c.T - half, axis=1)
                           for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Tree:
    branches: np.ndarray          # centres
    leaves: list[np.ndarray]      # centres of the leaves of each branch
    visits: int = 1

    @property
    def size(self) -> int:
        return sum(map(len, self.leaves))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = nearest(x, self.branches)
        leaf = np.zeros(len(x), np.int64)
        for i, c in enumerate(self.leaves):
            at = np.flatnonzero(b == i)
            leaf[at] = nearest(x[at], c)
        return b, leaf

    def walk(self, x: np.ndarray, visits: int, home: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Leaves (branch, leaf) of each query in the order of visit, its own leaf first."""
        root = x @ self.branches.T
        below = [x @ c.T for c in self.leaves]
        out = []
        for q in range(len(x)):
            queue = [(-s, b, -1) for b, s in enumerate(root[q])]
            heapq.heapify(queue)
            got = [home[q]]
            while queue and len(got) < visits:
                _, b, leaf = heapq.heappop(queue)
                if leaf < 0:
                    for i, s in enumerate(below[b][q]):
                        heapq.heappush(queue, (-s, b, i))
                elif (b, leaf) != home[q]:
                    got.append((b, leaf))
            out.append(got)
        return out


def fit(x: np.ndarray, k: int, recall: float = RECALL, seed: int = 11) -> Tree:
    rng = np.random.default_rng(seed)
    n_branch = max(1, min(64, round(len(x) / LEAF / FAN)))
    branches = kmeans(x, n_branch, rng)
    a = nearest(x, branches)
    leaves = [kmeans(x[a == i], max(1, round((a == i).sum() / LEAF)), rng) if (a == i).any()
              else branches[i:i + 1] for i in range(len(branches))]
    tree = Tree(branches, leaves)
    q = rng.choice(len(x), min(256, len(x)), replace=False)
    b, leaf = tree.assign(x)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    home = list(zip(b[q].tolist(), leaf[q].tolist(), strict=True))
    order = tree.walk(x[q], tree.size, home)
    need = []
    for i in range(len(q)):
        place = {z: n for n, z in enumerate(order[i], 1)}
        need += [place[(int(b[j]), int(leaf[j]))] for j in top[i]]
    # the smallest number of leaves at which this share of the exact neighbours is found
    tree.visits = int(np.quantile(need, recall, method="higher")) if need else tree.size
    return tree


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding); ``is_query``: a
    condition on vec_id."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) \
        & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") \
        .where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(ok)
    dim = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("embedding") == dim.d).distinct()
    few = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    copies = rows.withColumn("r", few).where(F.col("r") <= k + 1)
    per = stage(copies.groupBy("embedding").agg(F.min("vec_id").alias("vid"), F.array_sort(
        F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    asked = stage(rows.where(is_query(F.col("vec_id"))).join(per.select("embedding", "vid"), "embedding")
                  .select(F.col("vec_id").alias("query_id"), "vid"), "ann-queries")
    limit = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim.d)))
    sample = per.orderBy(F.xxhash64("vid"), "vid").limit(limit).select("embedding").toArrow()
    flat = sample["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tree = fit(flat.reshape(-1, dim.d).astype(np.float64), k, recall)
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(tree)           # at most SAMPLE / LEAF leaves and branches

    def assign(batches):
        for p in batches:
            if len(p):
                p["branch"], p["leaf"] = sent.value.assign(_matrix(p["embedding"]))
                yield p[["branch", "leaf", "vid", "embedding"]]

    member = stage(per.select("vid", "embedding").mapInPandas(
        assign, "branch int, leaf int, vid long, embedding array<float>"), "ann-members")

    def walk(batches):
        for p in batches:
            if not len(p):
                continue
            t = sent.value
            home = list(zip(p["branch"].tolist(), p["leaf"].tolist(), strict=True))
            by = []
            for vid, v, got in zip(p["vid"], p["embedding"], t.walk(_matrix(p["embedding"]), t.visits, home),
                                   strict=True):
                leaves: dict = {}
                for b, leaf in got:
                    leaves.setdefault(b, []).append(leaf)
                by += [(b, vid, v, x) for b, x in leaves.items()]
            yield pd.DataFrame(by, columns=["branch", "vid", "embedding", "leaves"])

    ask = member.join(asked.select("vid").distinct(), "vid", "left_semi")
    visit = stage(ask.mapInPandas(walk, "branch int, vid long, embedding array<float>, leaves array<int>"),
                  "ann-visits")
    # how many parts a branch and its queries are cut into: a row per branch
    size = member.groupBy("branch").agg(F.ceil(F.count("*") / PART).cast("int").alias("n_part"))
    size = size.join(visit.groupBy("branch").agg(F.ceil(F.count("*") / PART).cast("int").alias("q_part")), "branch")
    h = F.xxhash64("vid")
    left = member.join(size, "branch").withColumn("part", F.pmod(h, F.col("n_part")).cast("int")) \
        .withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("q_part") - 1))) \
        .select("branch", "part", "qp", "leaf", "vid", "embedding")
    right = visit.join(size, "branch").withColumn("qp", F.pmod(h, F.col("q_part")).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_part") - 1))) \
        .select("branch", "part", "qp", "vid", "embedding", "leaves")
    keep = k + 1

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "vid": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        x = x.sort_values("vid")
        ids, leaf, m, qm = x["vid"].to_numpy(), x["leaf"].to_numpy(), _matrix(x["embedding"]), _matrix(q["embedding"])
        seen = np.zeros((len(q), int(leaf.max()) + 1), bool)
        for i, ls in enumerate(q["leaves"]):
            ls = np.asarray(ls)
            seen[i, ls[ls < seen.shape[1]]] = True
        got = []
        for a in range(0, len(q), 512):
            s = np.where(seen[a:a + 512][:, leaf], qm[a:a + 512] @ m.T, -np.inf)
            floor = np.partition(s, -keep, axis=1)[:, -keep][:, None] if len(ids) > keep else -np.inf
            r, c = np.nonzero((s >= floor) & (s > -np.inf))
            order = np.lexsort((c, -s[r, c], r))
            r, c = r[order], c[order]
            first = np.searchsorted(r, r, side="left")
            top = np.arange(len(r)) - first < keep
            got.append((q["vid"].to_numpy()[a + r[top]], ids[c[top]], s[r[top], c[top]]))
        return pd.DataFrame({n: np.concatenate([g[i] for g in got]) for i, n in enumerate(("qid", "vid", "score"))})

    key = ["branch", "part", "qp"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "qid long, vid long, score double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vid"))
    found = found.withColumn("r", rank).where(F.col("r") <= keep).drop("r")
    ids = found.join(per.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))) \
        .where(F.col("r") <= keep).drop("r")
    mine = asked.join(ids, asked["vid"] == ids["qid"]).where("query_id <> vec_id")
    last = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", last).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
