"""Item-level choice scorer: a conditional logit fitted by Spark.

A choice row is ``(item, x, label)``; the model gives an item's choices the softmax of
``w . x``, and ``w`` maximises the probability of the choices labelled 1, less an L2
penalty.  The function is concave, so Newton steps reach its one maximum.

Choices are gathered by item once, at most about ``WHOLE`` to a row; an item with more has
several rows.  A step is one narrow pass: tasks add up loss, gradient and Hessian of the
items they hold whole, and return running sums under a running maximum for the rows of
larger items, which are merged per item before their loss is taken.  What reaches the
driver is one number per weight and pair of weights.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.files import stage

WHOLE = 1_000          # choices of a row, about
MAX_STEPS = 60


@dataclass
class ChoiceModel:
    weights: np.ndarray
    steps: int
    loss: float            # mean cross-entropy of the items with a gold choice
    n_items: int


class _Sums:
    """Running sums of one item: under the maximum ``m`` of its scores so far, the sums of
    e = exp(score - m), e x and e x x'; and number, score sum and x sum of gold choices."""

    def __init__(self, d: int):
        self.d, self.m, self.rest = d, -np.inf, np.zeros(1 + d + d * d)
        self.gold = np.zeros(2 + d)

    def add(self, m: float, rest: np.ndarray, gold: np.ndarray) -> None:
        top = max(self.m, m)
        old, new = (np.exp(v - top) if v > -np.inf else 0.0 for v in (self.m, m))
        self.m, self.rest, self.gold = top, old * self.rest + new * rest, self.gold + gold

    def rows(self, x: np.ndarray, z: np.ndarray, y: np.ndarray) -> None:
        e = np.exp(z - z.max())
        self.add(z.max(), np.concatenate([[e.sum()], e @ x, ((x * e[:, None]).T @ x).ravel()]),
                 np.concatenate([[y.sum(), y @ z], y @ x]))

    def terms(self) -> np.ndarray:
        """(items, loss, gradient, Hessian) of the finished item; zeros without a gold choice."""
        d, n = self.d, self.gold[0]
        if not n:
            return np.zeros(2 + d + d * d)
        rest = self.rest / self.rest[0]
        mean, square = rest[1:1 + d], rest[1 + d:].reshape(d, d)
        return np.concatenate([[1.0, n * (self.m + np.log(self.rest[0])) - self.gold[1]],
                               n * mean - self.gold[2:], n * (square - np.outer(mean, mean)).ravel()])


def _whole(x: np.ndarray, z: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of ``terms`` of items that begin at the rows ``at``."""
    size = np.diff([*at, len(z)])
    gold = np.add.reduceat(y, at)
    m = np.maximum.reduceat(z, at)
    e = np.exp(z - np.repeat(m, size))
    total = np.add.reduceat(e, at)
    p = e * np.repeat(gold / total, size)
    mean = np.add.reduceat(p[:, None] * x, at)
    has = gold > 0
    loss = (gold * (m + np.log(total))).sum() - y @ z
    hessian = (p[:, None] * x).T @ x - (mean[has] / gold[has, None]).T @ mean[has]
    return np.concatenate([[has.sum(), loss], mean.sum(axis=0) - y @ x, hessian.ravel()])


def gather(choices: DataFrame, item: str, features: str, label: str) -> DataFrame:
    """(item, salt, n, xs, ys): an item's choices in a row (salt null), or in several rows."""
    rows = choices.select(F.col(item).alias("item"), F.col(features).cast("array<double>").alias("x"),
                          F.col(label).cast("double").alias("y")).where(
        "item IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND forall(x, v -> v IS NOT NULL)")
    large = rows.groupBy("item").count().where(F.col("count") > WHOLE) \
        .select("item", F.ceil(F.col("count") / WHOLE).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    return rows.join(large, "item", "left").withColumn("salt", salt).groupBy("item", "salt").agg(
        F.collect_list(F.struct("x", "y")).alias("c")).select(
        "item", "salt", F.size("c").alias("n"), F.flatten("c.x").alias("xs"), F.col("c.y").alias("ys"))


def _step(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """Items, loss, gradient and Hessian of all items at ``w``."""
    d = len(w)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts = np.zeros(2 + d + d * d), []
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("xs").flatten()).reshape(-1, d)
            y, z = np.asarray(b.column("ys").flatten()), x @ w
            n = np.asarray(b.column("n"))
            end = np.cumsum(n)
            part = np.asarray(b.column("salt").is_valid())
            own = ~np.repeat(part, n)
            if own.any():
                total += _whole(x[own], z[own], y[own], np.cumsum(n[~part]) - n[~part])
            for i in np.flatnonzero(part):
                s, of = _Sums(d), slice(end[i] - n[i], end[i])
                s.rows(x[of], z[of], y[of])
                parts.append((b.column("item")[i].as_py(), np.concatenate([[s.m], s.rest, s.gold])))
        yield _vectors([None, *(p[0] for p in parts)], [total, *(p[1] for p in parts)], kind)

    def merge(keys: tuple, t: pa.Table) -> pa.Table:
        s = _Sums(d)
        for v in t["v"].to_pylist():
            s.add(v[0], np.array(v[1:2 + d + d * d]), np.array(v[2 + d + d * d:]))
        return pa.Table.from_batches([_vectors([None], [s.terms()], kind)])

    kind = rows.schema["item"].dataType
    schema = f"item {kind.simpleString()}, v array<double>"
    out = stage(rows.mapInArrow(local, schema), "choice-sums")
    several = out.where("item IS NOT NULL").groupBy("item").applyInArrow(merge, schema)
    got = out.where("item IS NULL").union(several).select(F.posexplode("v").alias("i", "v")) \
        .groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 + d + d * d)
    for r in got:
        total[r.i] = r.v
    return total


def _vectors(items: list, vectors: list[np.ndarray], kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(items, to_arrow_type(kind)), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))],
        ["item", "v"])


def fit_choice_scorer(choices: DataFrame, item: str, features: str = "x", label: str = "label",
                      penalty: float = 1e-3, tolerance: float = 1e-9) -> ChoiceModel:
    """Newton steps, halved while the penalised loss does not fall, until the step is below
    ``tolerance``.  Items without a gold choice do not count; rows with a null item, label
    or feature take no part.  Ends with an error when ``MAX_STEPS`` do not suffice."""
    d = choices.where(F.col(features).isNotNull()).agg(F.max(F.size(features))).first()[0] or 0
    rows = stage(gather(choices, item, features, label), "choice-rows")
    w = np.zeros(d)
    at = _step(rows, w)
    n = max(at[0], 1.0)

    def loss(v, t):
        return t[1] / n + penalty / 2 * (v @ v)

    for step in range(1, MAX_STEPS + 1):
        gradient = at[2:2 + d] / n + penalty * w
        move = -np.linalg.solve(at[2 + d:].reshape(d, d) / n + penalty * np.eye(d), gradient)
        size = 1.0
        while True:
            nxt = w + size * move
            there = _step(rows, nxt)
            if loss(nxt, there) <= loss(w, at) + 1e-12 or size < 1e-6:
                break
            size /= 2
        w, at = nxt, there
        if np.abs(size * move).max(initial=0.0) < tolerance:
            return ChoiceModel(w, step, float(at[1] / n), int(at[0]))
    raise RuntimeError(f"no convergence in {MAX_STEPS} steps")


def logit(weights, features: str = "x") -> Column:
    """``w . x`` as an expression."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(F.col(features), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def score_choices(choices: DataFrame, weights, features: str = "x") -> DataFrame:
    """``choices`` with ``logit`` in place of the features."""
    return choices.withColumn("logit", logit(weights, features)).drop(features)
