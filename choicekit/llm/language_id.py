"""Language identification (operator 6).

The mean of hashed subword embeddings (two to four bytes of a word with its ends marked,
and the word itself) goes into a linear softmax.  Both are trained by stochastic gradient
descent in numpy on at most ``PER_LANG`` documents of each language.  A temperature,
fitted on documents kept aside, calibrates the probabilities; a prediction under the
confidence at which accepted ones reach ``ACCEPT`` accuracy there is marked rejected.

As mean and softmax layer are linear, a subword's share of the scores is one row of
embedding x layer; whole texts are scored by adding rows per distinct word.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to
the language first in code point order; without any labelled row all are ``und``; repeated
rows get equal results; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, mix, pieces, tokens

PER_LANG = 700        # documents of a language the classifier is fitted on at most
BUCKETS = 1 << 16
DIM = 16
EPOCHS = 6
ACCEPT = 0.99
NGRAMS = (2, 3, 4)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray         # BUCKETS x languages: embedding x softmax layer
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, first subword of each word and the end)."""
    data = words.cast(pa.binary())
    size = np.asarray(pc.binary_length(data)).astype(np.int64)
    flat = np.frombuffer(b"".join(b"<" + x + b">" for x in data.to_pylist()), np.uint8).astype(np.uint64)
    length = size + 2
    start = np.cumsum(length) - length
    word = np.repeat(np.arange(len(size)), length)
    codes, owner = [], []
    for n in NGRAMS:
        h = np.zeros(max(0, len(flat) - n + 1), np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + flat[j:len(flat) - n + 1 + j] + np.uint64(1)
        same = word[:len(h)] == word[n - 1:n - 1 + len(h)] if len(h) else np.zeros(0, bool)
        codes.append(h[same] + np.uint64(n << 50))
        owner.append(word[:len(h)][same])
    run = np.zeros(len(size), np.uint64)
    if len(size):
        power = np.uint64(1099511628211)
        weight = mix(np.arange(len(flat), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64)) | np.uint64(1)
        run = np.add.reduceat(flat * weight, start) * power
    codes.append(run)
    owner.append(np.arange(len(size)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (mix(np.concatenate(codes)) & np.uint64(BUCKETS - 1)).astype(np.int64)[order]
    return bucket, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


def _bags(batches):
    """Bucket counts of each training text."""
    for b in pieces(batches):
        t = tokens(b.column("text"))
        sub, first = subwords(t.words)
        rows = []
        for a, z in zip(t.offsets[:-1], t.offsets[1:], strict=True):
            c, k = np.unique(t.codes[a:z], return_counts=True)
            if not len(c):
                rows.append(b"")
                continue
            bag = np.zeros(BUCKETS, np.float32)
            for w, times in zip(c, k, strict=True):
                np.add.at(bag, sub[first[w]:first[w + 1]], times)
            i = np.flatnonzero(bag)
            rows.append(i.astype(np.int32).tobytes() + bag[i].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(rows, pa.binary())], ["lang", "bag"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 7) -> Model | None:
    """``docs``: doc_id, text, lang; rows without lang or text teach nothing."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    pick = lowest(known, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_lang).select("doc_id").distinct()
    got = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang") \
        .join(F.broadcast(pick), "doc_id", "left_semi").mapInArrow(_bags, "lang string, bag binary").toArrow()
    bags, y0 = got["bag"].to_pylist(), got["lang"].to_pylist()
    # the order of rows that Spark returns is not fixed: sort them
    both = sorted(zip(y0, bags, strict=True))
    both = [x for x in both if x[1]]
    if not both:
        return None
    langs = sorted({x[0] for x in both})
    y = np.array([langs.index(x[0]) for x in both])
    idx = [np.frombuffer(x[1], np.int32, len(x[1]) // 8) for x in both]
    val = [np.frombuffer(x[1], np.float32, offset=len(x[1]) // 2) for x in both]
    val = [v / v.sum() for v in val]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    layer += rng.normal(0, 0.1, layer.shape)
    aside = rng.random(len(y)) < 0.15
    if aside.all() or len(y) < 20:
        aside[:] = False
    train = np.flatnonzero(~aside)

    def hidden(i):
        return val[i].astype(np.float64) @ emb[idx[i]]

    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 16)):
            h = np.stack([hidden(i) for i in part])
            g = _softmax(h @ layer + bias)
            g[np.arange(len(part)), y[part]] -= 1
            back = g @ layer.T
            layer -= rate * h.T @ g / len(part) * 4
            bias -= rate * g.mean(axis=0) * 0.1
            for j, i in enumerate(part):
                # a mean of many buckets moves little, so the step is scaled to their spread
                emb[idx[i]] -= (rate * 40 / len(part) * val[i][:, None] * back[j][None, :]).astype(np.float32)
    held = np.flatnonzero(aside) if aside.any() else train
    z = np.stack([hidden(i) for i in held]) @ layer + bias
    temps = np.geomspace(0.05, 8, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in temps]
    temp = float(temps[int(np.argmin(loss))])
    p = _softmax(z / temp)
    conf, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    order = np.argsort(-conf, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPT
    threshold = float(conf[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return Model(langs, (emb.astype(np.float64) @ layer).astype(np.float32), bias, temp, min(threshold, 0.9))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text."""
    def rows(batches):
        for b in pieces(batches):
            text = pc.fill_null(b.column("text"), "")
            letter = np.asarray(pc.match_substring_regex(text, r"\p{L}")).astype(bool)
            if model is None:
                letter[:] = False
            pred = np.full(b.num_rows, "und", dtype=object)
            conf = np.zeros(b.num_rows)
            if letter.any():
                t = tokens(text)
                sub, first = subwords(t.words)
                per = np.add.reduceat(model.scores[sub].astype(np.float64), first[:-1], axis=0)
                n = np.diff(first)
                doc = np.repeat(np.arange(b.num_rows), np.diff(t.offsets))
                count = np.maximum(1, np.bincount(doc, n[t.codes], b.num_rows))
                z = np.stack([np.bincount(doc, per[t.codes, k], b.num_rows)
                              for k in range(len(model.langs))], axis=1) / count[:, None] + model.bias
                p = _softmax(z / model.temperature)
                pred[letter] = np.array(model.langs, dtype=object)[p.argmax(axis=1)[letter]]
                conf[letter] = p.max(axis=1)[letter]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pred.tolist(), pa.string()), pa.array(conf),
                 pa.array(conf < (model.threshold if model else 1.0))],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, lang_pred string, score double, rejected boolean")
