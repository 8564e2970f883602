"""Toxicity by cumulative-link ordinal regression (operator 10).

Severity grades are ordered: 0 clean, 1 and 2 toxic below and above the median rate of
toxic features among labelled toxic documents.  One weight per sparse text feature is
shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1.  A feature is
the presence of a word, or of a word start of four or five letters (which reaches inflected
forms); the fit is proximal gradient descent with an L1 penalty on at most ``TRAIN_ROWS``
labelled documents.  Every document is scored on its whole text; the expected severity is
the sum of P(grade > k).

Defined results: null or blank text has no feature and the severity of the intercepts;
labels that are null, or of documents that don't exist, take no part; without both label
values nothing is rejected and severity is 0; repeated rows get equal results, rows with a null id results of their own; an empty
table gives an empty result; other columns are kept by ``reject`` and ignored elsewhere.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lowest, pieces, stage, tokens

TRAIN_ROWS = 8_000          # labelled documents the classifier is fitted on at most
FEATURES = 4_096            # features it may use, most telling first
PREFIXES = (4, 5)
STRIP = b".,;:!?\"'()[]{}<>*#-_%$&"
L1 = 4e-4


def word_features(word: bytes) -> list[int]:
    w = word.strip(STRIP).decode("utf-8", "replace").lower()
    if not w:
        return []
    out = [xxhash.xxh3_64_intdigest("=" + w)]
    out += [xxhash.xxh3_64_intdigest("^" + w[:n]) for n in PREFIXES if len(w) >= n]
    return [x >> 1 for x in out]


@dataclass
class Model:
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))     # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([40.0, 41.0]))
    cut: float = 2.0                                                            # of P(grade > 0)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        t = tokens(b.column("text"))
        feats = [np.array(word_features(w), np.int64) for w in t.words.to_pylist()]
        rows = []
        for a, z in zip(t.offsets[:-1], t.offsets[1:], strict=True):
            u = np.unique(t.codes[a:z])
            rows.append(np.unique(np.concatenate([feats[i] for i in u])).tobytes() if len(u) else b"")
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(np.diff(t.offsets)),
                                          pa.array(rows, pa.binary())], ["toxic", "n", "features"])


def _solve(y: np.ndarray, start: np.ndarray, col: np.ndarray, n_col: int, weight: np.ndarray,
           steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by accelerated proximal gradient."""
    row = np.repeat(np.arange(len(y)), np.diff(start))
    grades = int(y.max())
    above = y[:, None] > np.arange(grades)[None, :]
    rate = np.clip((weight[:, None] * above).sum(0) / weight.sum(), 1e-4, 1 - 1e-4)
    t = np.log(1 / rate - 1)
    w = np.zeros(n_col)
    z, zt, k = w.copy(), t.copy(), 1.0
    total = weight.sum()
    lip = (np.bincount(row, minlength=len(y)).mean() + 4) * grades / 4
    for _ in range(steps):
        x = np.bincount(row, z[col], len(y))
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - zt[None, :], -40, 40)))
        r = (p - above) * weight[:, None] / total
        g = np.bincount(col, r.sum(1)[row], n_col)
        w2 = z - g / lip * 4
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - L1 / lip * 4, 0)
        t2 = np.sort(zt + r.sum(0) / lip * 4)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        z, zt = w2 + (k - 1) / k2 * (w2 - w), t2 + (k - 1) / k2 * (t2 - t)
        w, t, k = w2, t2, k2
    return w, np.maximum.accumulate(t + np.arange(grades) * 1e-6)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """``_fit``, with the driver's memory given back after it."""
    model = _fit(docs, labels, rows)
    give_back()
    return model


def _fit(docs: DataFrame, labels: DataFrame, rows: int) -> Model:
    """The model of the labelled documents.  The sample, of labels whose documents are
    there: the ``rows`` lowest hashes of doc_id, and those of each label value up to an
    eighth of ``rows``, so a rare value is in it too."""
    have = docs.where("doc_id IS NOT NULL").select(F.col("doc_id"))
    pick = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")).join(have, "doc_id", "left_semi")
    pick = stage(pick, "labelled")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lowest(pick, [], order, rows).union(lowest(pick, ["toxic"], order, max(1, rows // 8))).distinct()
    got = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("doc_id", "toxic", "text") \
        .mapInArrow(_train_rows, "toxic int, n long, features binary").toArrow()
    toxic = np.asarray(got["toxic"])
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model()
    n = np.maximum(1, np.asarray(got["n"]))
    # the features of all rows are one buffer: no copy of them as Python objects
    column = got["features"].cast(pa.large_binary()).combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) // 8
    start = at - at[0]
    ids, col = np.unique(np.frombuffer(column.buffers()[2], np.int64)[at[0]:at[-1]], return_inverse=True)
    del got, column
    col = col.astype(np.int32)
    row_y = np.repeat(toxic.astype(np.int8), np.diff(start))
    pos, neg = (np.bincount(col, row_y == v, len(ids)) for v in (1, 0))
    n1, n0 = (toxic == 1).sum(), (toxic == 0).sum()
    # signed root of the log-likelihood ratio of presence against the label
    p, q = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    tell = pos * np.log(p / q) + (n1 - pos) * np.log((1 - p) / (1 - q))
    order = np.argsort(-np.where(pos + neg >= 3, tell, -1e9), kind="stable")[:FEATURES]
    order = order[tell[order] > 2]
    place = np.full(len(ids), -1)
    place[order] = np.arange(len(order))
    keep = place[col] >= 0
    row = np.repeat(np.arange(len(toxic)), np.diff(start))[keep]
    col = place[col[keep]]
    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(toxic)))])
    strong = (p / q > 8)[order]
    rate = np.bincount(row, strong[col], len(toxic)) / n
    grade = np.where(toxic == 1, 1 + (rate > np.median(rate[toxic == 1])), 0)
    weight = np.where(toxic == 1, 0.5 / n1, 0.5 / n0) * len(toxic)
    w, t = _solve(grade, start, col, len(order), weight)
    if len(t) == 1:                      # one rate for all toxic documents: no second grade
        t = np.append(t, t[0] + 40)
    x = np.bincount(row, w[col], len(toxic))
    prob = 1 / (1 + np.exp(-np.clip(x - t[0], -40, 40)))
    # the cut between clean and toxic: best F1, in the middle of the gap where it is best
    s = np.unique(prob)
    mids = np.concatenate([(s[:-1] + s[1:]) / 2, [0.5]])
    if len(mids) > 2000:
        mids = np.quantile(mids, np.linspace(0, 1, 2000))
    a, b = np.sort(prob[toxic == 1]), np.sort(prob[toxic == 0])
    tp, fp = len(a) - np.searchsorted(a, mids), len(b) - np.searchsorted(b, mids)
    f1 = 2 * tp / (tp + fp + len(a))
    best = mids[f1 >= f1.max() - 1e-9]
    some = np.flatnonzero(w)
    by = np.argsort(ids[order[some]])
    return Model(ids[order[some]][by], w[some][by], t, float(np.median(best)))


def _scorer(model: Model):
    """The function of a slice to its thresholds' probabilities, a row of P(grade > k) each."""
    table = dict(zip(model.ids.tolist(), range(len(model.ids)), strict=True))
    w, t = model.weights, model.thresholds

    def probabilities(b: pa.RecordBatch) -> np.ndarray:
        k = tokens(b.column("text"))
        hit = [[table[f] for f in word_features(x) if f in table] for x in k.words.to_pylist()]
        any_ = np.fromiter(map(bool, hit), bool, len(hit))
        doc = np.repeat(np.arange(b.num_rows), np.diff(k.offsets))
        here = any_[k.codes] if len(k.codes) else np.zeros(0, bool)
        pairs = {(d, f) for d, c in zip(doc[here].tolist(), k.codes[here].tolist(), strict=True)
                 for f in hit[c]}
        x = np.zeros(b.num_rows)
        for d, f in sorted(pairs):
            x[d] += w[f]
        return 1 / (1 + np.exp(-np.clip(x[:, None] - t[None, :], -40, 40)))

    return probabilities


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (0 to 2), p_toxic, toxic (boolean) of every row."""
    probabilities, cut = _scorer(model), model.cut

    def rows(batches):
        for b in pieces(batches):
            p = probabilities(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= cut)],
                ["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, severity double, p_toxic double, toxic boolean")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """Documents that aren't toxic, with all their columns.  Each row is judged by its own
    text, whatever its doc_id."""
    probabilities, cut = _scorer(model), model.cut

    def rows(batches):
        for b in pieces(batches):
            yield b.filter(pa.array(probabilities(b)[:, 0] < cut))

    return docs.mapInArrow(rows, docs.schema)
