"""Hidden Markov language model (operator 2).

A text is its words and one end token.  Words fall into classes: each of the ``OWN`` most
frequent training words is one, the end token is one, all others share ``SHARED`` classes
by their last three bytes.  The model is

    P(text) = P_hmm(class sequence) * prod P(word | class)

with ``STATES`` hidden states over classes, and P(word | class) = (c + 1) / (N_class +
V_class + 1) in a shared class, where one share of the class is left for unseen words.

Baum-Welch runs over all training texts: every task emits the expected counts of its
texts, Spark adds them up per class, and the M step sees tables of a size fixed by STATES
and the number of classes.  Texts are cut into chunks that are run side by side; transfer
matrices of a text's chunks give each chunk its exact forward and backward messages, so
neither training nor the scaled forward score depends on the cut.

Counts of the ``HEAD`` most frequent words travel to the tasks; all other words are joined
with the full count table.

Defined results: null text is empty (one end token); a null doc_id trains and isn't held
out; repeated rows are scored each; without training rows all counts are 0 and the model
is the untrained one; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stage, tokens

STATES = 6
OWN = 4095             # words with a class of their own
SHARED = 2048
HEAD = 1 << 16         # words whose counts every task gets
ITERATIONS = 4
CHUNK = 2048           # tokens of a chunk
CELLS = 1 << 18        # tokens of chunks run side by side
TINY = 1e-290
EVERY = 8              # steps between scalings; emissions stay far from underflow
END, CLASSES = 0, 1 + OWN + SHARED


def shared_class(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-3:]) % SHARED


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit      # K, K x K, CLASSES x K

    @classmethod
    def initial(cls, class_counts: np.ndarray, seed: int = 3) -> Hmm:
        rng = np.random.default_rng(seed)
        k = STATES
        emit = (class_counts[:, None] + 0.5) * np.exp(rng.normal(0, 1.0, (CLASSES, k)))
        move = np.full((k, k), 0.1 / max(1, k - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(k, 1 / k), move, emit / emit.sum(axis=0))

    def step(self, init: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> Hmm:
        prior = (class_counts + 0.5) / (class_counts + 0.5).sum()
        emit = emit + 20 * prior[:, None]
        move, init = move + 0.1, init + 0.1
        return Hmm(init / init.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _cut(seqs: list[np.ndarray]):
    """Chunks (text, classes) of at most CHUNK tokens, in order of text."""
    return [(i, s[a:a + CHUNK]) for i, s in enumerate(seqs) for a in range(0, max(1, len(s)), CHUNK)]


def _batches(chunks, order, width: int = 1):
    """Chunks side by side, longest first: (their numbers, classes by step and chunk, sizes,
    how many still run at each step).  ``order`` falls in size."""
    a = 0
    while a < len(order):
        long = len(chunks[order[a]][1])
        part = order[a:a + max(1, CELLS // (long * width))]
        a += len(part)
        size = np.array([len(chunks[j][1]) for j in part])
        obs = np.zeros((long, len(part)), np.int64)
        for c, j in enumerate(part):
            obs[:size[c], c] = chunks[j][1]
        yield part, obs, size, np.searchsorted(-size, -np.arange(long), side="left").tolist()


def _messages(m: Hmm, chunks):
    """Per chunk the state distribution that enters it, and the likelihood, up to a factor,
    of all that follows it by the state that would enter next (None at a text's end)."""
    k = len(m.start)
    enter, after = [m.start] * len(chunks), [None] * len(chunks)
    head = [j + 1 < len(chunks) and chunks[j + 1][0] == chunks[j][0] for j in range(len(chunks))]
    tail = [j > 0 and head[j - 1] for j in range(len(chunks))]
    many = [j for j in range(len(chunks)) if head[j] or tail[j]]
    if not many:
        return enter, after
    transfer: dict[int, np.ndarray] = {}
    emit_t, move_t = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    for part, obs, _, live in _batches(chunks, sorted(many, key=lambda j: -len(chunks[j][1])), k):
        e = emit_t[:, obs]
        p = np.repeat(np.eye(k)[:, :, None], len(part), axis=2)        # state, entering state, chunk
        for t in range(len(obs)):
            c = live[t]
            x = (move_t @ (p[:, :, :c] * e[:, None, t, :c]).reshape(k, -1)).reshape(k, k, c)
            p[:, :, :c] = x / x.sum(axis=(0, 1)) if t % EVERY == EVERY - 1 else x
        for c, j in enumerate(part):
            transfer[j] = p[:, :, c].T                                 # entering state, leaving state
    for j in many:                                                     # left to right
        if tail[j]:
            v = enter[j - 1] @ transfer[j - 1]
            enter[j] = v / v.sum()
    for j in reversed(many):
        if head[j]:
            v = transfer[j + 1] @ (after[j + 1] if head[j + 1] else np.ones(k))
            after[j] = v / v.sum()
    return enter, after


def expected(m: Hmm, seqs: list[np.ndarray]):
    """Expected counts of starts, moves and emissions over whole texts."""
    k = len(m.start)
    init, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    chunks = _cut(seqs)
    enter, after = _messages(m, chunks)
    emit_t, move_t = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    for part, obs, size, live in _batches(chunks, sorted(range(len(chunks)), key=lambda j: -len(chunks[j][1]))):
        n_t, n = obs.shape
        e = emit_t[:, obs]                                             # state, step, chunk
        alpha, right = np.zeros((k, n_t, n)), np.zeros((k, n_t, n))
        p = np.stack([enter[j] for j in part], axis=1)
        for t in range(n_t):
            c = live[t]
            a = p[:, :c] * e[:, t, :c]
            if t % EVERY == 0:
                a /= a.sum(axis=0)
            alpha[:, t, :c] = a
            p[:, :c] = move_t @ a
        # beta of a chunk's last step: what follows it, seen through one move
        b = np.stack([m.move @ after[j] if after[j] is not None else np.ones(k) for j in part], axis=1)
        b /= b.sum(axis=0)
        for t in range(n_t - 1, -1, -1):
            c = live[t]
            x = e[:, t, :c] * b[:, :c]                                 # emission x beta of this step
            right[:, t, :c] = x
            if t:
                if t % EVERY == 0:
                    x = x / x.sum(axis=0)
                b[:, :c] = m.move @ x
        # steps past a chunk's end hold zeros and add nothing
        if n_t > 1:
            left, r = alpha[:, :-1].reshape(k, -1), right[:, 1:].reshape(k, -1)
            z = np.einsum("ij,ij->j", move_t @ left, r)
            move += m.move * (left @ (r / np.maximum(z, TINY)).T)
        for c, j in enumerate(part):
            if after[j] is not None:
                x = alpha[:, size[c] - 1, c][:, None] * m.move * after[j][None, :]
                move += x / x.sum()
        # alpha x beta = alpha x (emission x beta) / emission
        gamma = alpha
        gamma *= right
        gamma /= e
        gamma = gamma.reshape(k, -1)
        gamma /= np.maximum(gamma.sum(axis=0), TINY)
        o = obs.ravel()
        for s in range(k):
            emit[:, s] += np.bincount(o, gamma[s], CLASSES)
        first = np.array([not (j and chunks[j - 1][0] == chunks[j][0]) for j in part])
        init += gamma[:, :n][:, first].sum(axis=1)
    return init, move, emit


def log_likelihood(m: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each class sequence: scaled forward recursion."""
    out = np.zeros(len(seqs))
    chunks = _cut(seqs)
    enter, _ = _messages(m, chunks)
    emit_t, move_t = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
    for part, obs, size, live in _batches(chunks, sorted(range(len(chunks)), key=lambda j: -len(chunks[j][1]))):
        e = emit_t[:, obs]
        p = np.stack([enter[j] for j in part], axis=1)
        ll = np.zeros(len(part))
        for t in range(len(obs)):
            c = live[t]
            a = p[:, :c] * e[:, t, :c]
            stop = live[t + 1] if t + 1 < len(obs) else 0
            if t % EVERY == 0:
                z = a.sum(axis=0)
                a /= z
                ll[:c] += np.log(z)
            if stop < c:                                               # chunks that end here
                ll[stop:c] += np.log(a[:, stop:c].sum(axis=0))
            p[:, :c] = move_t @ a
        np.add.at(out, [chunks[j][0] for j in part], ll)
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts; a task adds up its own words before the shuffle."""
    def rows(batches):
        for b in pieces(batches, limit=24 << 20):
            t = tokens(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [t.words, pa.array(np.bincount(t.codes, minlength=len(t.words)).astype(np.int64))], ["word", "c"])

    return docs.select("text").mapInArrow(rows, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame, is_held=held_out, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .withColumn("held", is_held(F.col("doc_id")))
    counts = stage(word_counts(docs.where("NOT held")), "lm-counts")
    n_train = docs.where("NOT held").count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = (total.n or 0) + n_train, total.v + (1 if n_train else 0)
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    pairs = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    own = {w: i + 1 for i, (_, w) in enumerate(pairs[:OWN])}
    sums = counts.groupBy((F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(SHARED)) + 1 + OWN).alias("k")) \
        .agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        size[r.k], kinds[r.k] = r.n, r.v
    for w, (c, _) in zip(own, pairs, strict=False):
        size[shared_class(w)] -= c
        kinds[shared_class(w)] -= 1
        size[own[w]] = c
    size[END] = n_train
    share = np.log10(size + kinds + 1)                       # of a shared class, its denominator
    # word -> class, log10(c + 1), log10 P(word | class)
    head = {w: (own[w], np.log10(c + 1), 0.0) if w in own else
            (shared_class(w), np.log10(c + 1), np.log10(c + 1) - share[shared_class(w)]) for c, w in pairs}
    end = (n_train, np.log10(n_train + 1))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((head, share))       # HEAD words at most

    def sequences(batches):
        table, denominators = sent.value
        for b in pieces(batches):
            t = tokens(b.column("text"))
            words = t.words.to_pylist()
            cls, lc, le = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(words))
            tail = np.zeros(len(words), bool)
            for i, w in enumerate(words):
                if (x := table.get(w)) is not None:
                    cls[i], lc[i], le[i] = x
                else:
                    cls[i], tail[i] = shared_class(w), True
                    le[i] = -denominators[cls[i]]
            out = []
            for a, z in zip(t.offsets[:-1], t.offsets[1:], strict=True):
                code = t.codes[a:z]
                rest = code[tail[code]]
                u, n = np.unique(rest, return_counts=True)
                out.append((len(code) + 1, len(code) - len(rest) + (end[0] > 0), float(lc[code].sum() + end[1]),
                            float(le[code].sum()), np.append(cls[code], END).astype("<u2").tobytes(),
                            [words[i] for i in u], n.tolist()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held"),
                 *(pa.array([r[i] for r in out], k) for i, k in enumerate(
                     (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(),
                      pa.list_(pa.binary()), pa.list_(pa.int64()))))],
                ["doc_id", "held", "n", "known", "lc", "le", "seq", "words", "times"])

    seq = docs.select("doc_id", "held", "text").mapInArrow(
        sequences, "doc_id long, held boolean, n long, known long, lc double, le double, "
                   "seq binary, words array<binary>, times array<long>")
    seq = stage(seq.withColumn("rid", F.monotonically_increasing_id()), "lm-sequences")

    # the words outside the head: counts by an exact join, back to their rows as sums
    tail = seq.where(F.size("words") > 0).select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")) \
        .select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    tail = tail.join(counts, "word").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("tail_lc"), F.sum("k").alias("tail_known"))

    model = Hmm.initial(size)
    train = seq.where("NOT held").select("seq")
    k = STATES
    for _ in range(iterations):
        model = model.step(*_gather(train, model, k), size)
    fitted = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def forward(batches):
        m = Hmm(*fitted.value)
        for b in pieces(batches, "seq", 2 << 20):
            s = [np.frombuffer(x, "<u2").astype(np.int64) for x in b.column("seq").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("rid", "doc_id", "held", "n", "known", "lc", "le")),
                 pa.array(log_likelihood(m, s) / np.log(10))],
                ["rid", "doc_id", "held", "n", "known", "lc", "le", "hmm"])

    out = seq.select("rid", "doc_id", "held", "n", "known", "lc", "le", "seq").mapInArrow(
        forward, "rid long, doc_id long, held boolean, n long, known long, lc double, le double, hmm double")
    zero = F.lit(0.0)
    base = float(np.log10(n_all + v_all + 1))
    return out.join(tail, "rid", "left").select(
        "doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("lc") + F.coalesce("tail_lc", zero) - F.col("n") * F.lit(base)).alias("base_score"),
        (F.col("hmm") + F.col("le") + F.coalesce("tail_lc", zero)).alias("score"))


def _gather(train: DataFrame, model: Hmm, k: int):
    """One E step: expected counts of all training texts, added up by Spark."""
    start, move, emit = model.start, model.move, model.emit
    sent = train.sparkSession.sparkContext.broadcast((start, move, emit))

    def rows(batches):
        m = Hmm(*sent.value)
        init, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        for b in pieces(batches, "seq", 1 << 20):
            s = [np.frombuffer(x, "<u2").astype(np.int64) for x in b.column("seq").to_pylist()]
            a, c, e = expected(m, s)
            init, moves, emits = init + a, moves + c, emits + e
        table = np.concatenate([init[None, :], moves, emits])
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(table[some, i]) for i in range(k))], ["r", *(f"s{i}" for i in range(k))])

    got = train.mapInArrow(rows, ", ".join(["r long", *(f"s{i} double" for i in range(k))])) \
        .groupBy("r").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).toArrow()
    table = np.zeros((1 + k + CLASSES, k))
    table[np.asarray(got["r"])] = np.stack([np.asarray(got[f"s{i}"]) for i in range(k)], axis=1)
    sent.destroy()
    return table[0], table[1:1 + k], table[1 + k:]
