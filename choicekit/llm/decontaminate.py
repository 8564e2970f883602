"""Benchmark decontamination (operator 1).

Items of a benchmark and windows of documents as long as the items are compared as bags of
five-word shingles.  A window's SimHash (64 bits; every shingle votes with its number of
occurrences) comes from running sums, so each window costs the same whatever its length.
Item lengths fall into classes a tenth apart, and a class has one window length, not above
its items'; an item is indexed by the fingerprint of each of its own windows of that
length, so a whole copy of it always holds a window with the very same fingerprint.

Multi-index search: the radii of the four 16-bit blocks, each plus one, add up to more than
``RADIUS``, so two fingerprints within ``RADIUS`` bits are within its radius in some block,
and tables of all such block values lead to every item within the radius.  Windows start up
to three words apart (a twelfth of their length), never more than an item has windows.

Fingerprints of similar bags can be more than ``RADIUS`` bits apart, so each item also has
keys: so many of its shingles, the rarest of the benchmark first, that a bag of similarity
``SIMILARITY`` cannot lack all of them.  Every shingle of a document is looked up among the
keys, which loses no passage.

A hit is verified exactly: weighted Jaccard similarity (sum of the smaller counts over sum
of the larger) of the item's shingles and of each window of the item's own length that
holds the key or is near the fingerprint's window; the best is at least ``SIMILARITY``.

Items are sent to the tasks ``ITEMS`` at a time; a larger benchmark takes more passes.

Defined results: null or blank texts and items match nothing; an item of fewer words than
five is compared by shingles of all its words; a document shorter than a window is one
window; repeated rows and items each give their rows, also rows with a null id; an empty table gives an empty
result; other columns are kept by ``clean`` and ignored elsewhere.
"""
from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, stage, tokens

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 11
BLOCK_RADII = (2, 2, 2, 2)
ITEMS = 4_096
CLASS_STEP = 1.1
STREAM = 16_000         # words of a document, or of several, compared at once
RUN = 64                # running sums are taken inside blocks of so many rows first
WINDOWS = 1_024         # windows whose votes are counted at once: they stay in the processor's cache


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        h = mix(h + w[j:j + len(h)] + np.uint64(j + 1))
    return h


def votes(h: np.ndarray) -> np.ndarray:
    """Set bits of each shingle, a row of 64."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)


def running_votes(h: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the votes, a row of zeros first.  The sums wrap around; the difference
    of two rows at most ``longest`` apart is exact, in the smallest type that holds it."""
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    blocks = np.zeros((len(h) // RUN + 1, RUN, 64), kind)
    sums = blocks.reshape(-1, 64)
    sums[1:len(h) + 1] = votes(h)
    for j in range(1, RUN):              # inside all blocks at once, then from block to block
        blocks[:, j] += blocks[:, j - 1]
    blocks[1:] += np.add.accumulate(blocks[:-1, -1], axis=0, dtype=kind)[:, None]
    return sums[:len(h) + 1]


def fingerprint(ones: np.ndarray, n: int) -> np.ndarray:
    """SimHash from the number of set votes of n shingles."""
    return np.packbits(ones > n // 2).view(np.uint64).reshape(ones.shape[:-1])


def window_prints(sums: np.ndarray, n: int, step: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles, ``step`` apart, a few at a time."""
    high, low = sums[n::step], sums[:-n:step]
    out = np.empty(len(high), np.uint64)
    ones = np.empty((min(WINDOWS, len(high)), 64), sums.dtype)
    for i in range(0, len(high), WINDOWS):
        part = ones[:len(high) - i]
        out[i:i + WINDOWS] = fingerprint(np.subtract(high[i:i + WINDOWS], low[i:i + WINDOWS], out=part), n)
    return out


class Index:
    """Items of one shingle length and length class."""

    near = [np.array(sorted(sum(1 << b for b in c) for n in range(r + 1)
                            for c in combinations(range(16), n)), np.uint16) for r in BLOCK_RADII]

    def __init__(self, words: int, k: int):
        self.words, self.k, self.items = words, k, []

    def build(self) -> Index:
        n = self.words - self.k + 1
        sums = [running_votes(s, n) for _, _, s in self.items]
        prints = [fingerprint(s[n:] - s[:-n], n) for s in sums]
        self.prints = np.concatenate(prints)
        self.owner = np.repeat(np.arange(len(prints)), [len(x) for x in prints])
        blocks = self.prints.view(np.uint16).reshape(-1, len(BLOCK_RADII))
        self.tables = []
        for b, near in enumerate(self.near):
            value = (blocks[:, b][:, None] ^ near[None, :]).ravel()
            item = np.repeat(np.arange(len(blocks)), len(near))
            order = np.argsort(value, kind="stable")
            count = np.bincount(value, minlength=1 << 16)
            self.tables.append((count > 0, count, np.cumsum(count) - count, item[order]))
        return self

    def search(self, prints: np.ndarray) -> np.ndarray:
        """Rows (window, item, distance) within RADIUS bits, each once."""
        out = []
        blocks = prints.view(np.uint16).reshape(-1, len(BLOCK_RADII))
        for b, (some, count, start, item) in enumerate(self.tables):
            # a table has a place for every value of a block: taking needs no check of bounds
            at = np.flatnonzero(some.take(blocks[:, b], mode="wrap"))
            v = blocks[at, b]
            n = count.take(v, mode="wrap")
            w = np.repeat(at, n)
            end = np.cumsum(n)
            i = item[np.repeat(start.take(v, mode="wrap") - end + n, n) + np.arange(end[-1] if len(end) else 0)]
            far = np.bitwise_count(prints[w] ^ self.prints[i])
            close = far <= RADIUS
            if close.any():
                out.append(np.stack([w[close], self.owner[i[close]], far[close]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


class Keys:
    """Shingles of the items of one shingle length.  An item of m shingles and a window of its
    length differ by m (1 - SIMILARITY) / (1 + SIMILARITY) occurrences at the most; a whole
    document shorter than the item lacks m (1 - SIMILARITY) of them at the most."""

    def __init__(self, classes: list[Index], k: int):
        own = [(number, j, *np.unique(s, return_counts=True), n, len(s))
               for number, c in enumerate(classes) if c.k == k for j, (_, n, s) in enumerate(c.items)]
        value, total = np.unique(np.concatenate([x[2] for x in own]), return_counts=True)
        rows = []
        for number, j, x, count, n, m in own:
            order = np.lexsort((x, total[np.searchsorted(value, x)]))
            end = np.cumsum(count[order])
            whole, short = (int(np.searchsorted(end, int(m * lack + 1e-9), side="right")) + 1
                            for lack in ((1 - SIMILARITY) / (1 + SIMILARITY), 1 - SIMILARITY))
            rows += [(x[i], number, j, n, at >= whole) for at, i in enumerate(order[:short])]
        rows.sort()
        self.value = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1:] for r in rows], np.int64)      # class, item, words, short only
        self.some = np.zeros(1 << 16, bool)
        self.some[self.value & np.uint64(0xFFFF)] = True

    def search(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, row of ``item``) of every key among the shingles h."""
        at = np.flatnonzero(self.some[h & np.uint64(0xFFFF)])
        low = np.searchsorted(self.value, h[at])
        n = np.searchsorted(self.value, h[at], side="right") - low
        end = np.cumsum(n)
        return np.repeat(at, n), np.repeat(low - end + n, n) + np.arange(end[-1] if len(end) else 0)


def keys_of(classes: list[Index]) -> dict[int, Keys]:
    return {k: Keys(classes, k) for k in sorted({c.k for c in classes})}


def build(items: list[tuple[int, str | None]]) -> list[Index]:
    classes: dict = {}
    for item_id, text in items:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        k = min(SHINGLE, len(words))
        long = max(k, len(words) - min(2, len(words) // 12))
        step = int(np.log(long) / np.log(CLASS_STEP))
        size = max(round(CLASS_STEP ** (step + 1)) if round(CLASS_STEP ** (step + 1)) <= long else 0,
                   round(CLASS_STEP ** step), k)
        key = (min(size, long), k)
        classes.setdefault(key, Index(*key)).items.append(
            (item_id, len(words), shingles(word_hashes(words), k)))
    return [c.build() for _, c in sorted(classes.items())]


def _streams(offsets: np.ndarray, overlap: int):
    """(document, first word, words) pieces, grouped to about STREAM words; a longer
    document is cut into pieces that overlap by ``overlap`` words."""
    group, n = [], 0
    for d, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at = 0
        while at < z - a:
            size = min(z - a - at, STREAM + overlap)
            group.append((d, at, int(size)))
            n += size
            if n >= STREAM:
                yield group
                group, n = [], 0
            if at + size >= z - a:
                break
            at += size - overlap
    if group:
        yield group


def best_window(words: np.ndarray, item, k: int, spans: list[tuple[int, int]]) -> tuple[float, int]:
    """Similarity and start of the item-long window most like the item, of those that start
    within the spans."""
    _, n, s = item
    last, m = max(0, len(words) - n), min(n, len(words)) - k + 1
    merged: list = []
    for low, high in sorted((max(0, min(a, last)), max(0, min(z, last))) for a, z in spans):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    want = Counter(s.tolist())
    best, start = 0, 0
    for low, high in merged:
        h = shingles(words[low:high + n], k).tolist()
        left, both = dict(want), 0           # of the item's occurrences, those the window lacks
        for i, x in enumerate(h):
            if i >= m and h[i - m] in left:
                y = h[i - m]
                left[y] += 1
                both -= left[y] > 0
            if x in left:
                both += left[x] > 0
                left[x] -= 1
            if i >= m - 1 and both > best:
                best, start = both, low + i - m + 1
    return best / max(1, len(s) + m - best), start


def matches(batch: pa.RecordBatch, classes: list[Index], keys: dict[int, Keys]) -> list[tuple]:
    """(row, item_id, similarity, start word, words) of every item found in every text."""
    t = tokens(batch.column("text"))
    words = word_hashes(t.words.to_pylist())[t.codes] if len(t.codes) else np.zeros(0, np.uint64)
    longest = max((c.words for c in classes), default=0)
    hits: dict = {}                      # (text, class, item): (first, last) start to verify
    for group in _streams(t.offsets, 2 * longest):
        w = np.concatenate([words[t.offsets[d] + a:t.offsets[d] + a + n] for d, a, n in group])
        size = np.array([n for _, _, n in group])
        first = np.cumsum(size) - size
        sums: dict = {}
        for number, c in enumerate(classes):
            if c.k not in sums:
                h = shingles(w, c.k)
                sums[c.k] = running_votes(h, longest)
                place, row = keys[c.k].search(h)
                g = np.searchsorted(first, place, side="right") - 1
                for i, p, (cls, j, n, short) in zip(g.tolist(), place.tolist(), keys[c.k].item[row].tolist(),
                                                    strict=True):
                    d, a, size_ = group[i]
                    p -= int(first[i])
                    if p + c.k <= size_ and (not short or t.offsets[d + 1] - t.offsets[d] < n):
                        hits.setdefault((d, cls, j), set()).add((a + p - (n - c.k), a + p))
            s, n = sums[c.k], c.words - c.k + 1
            step, slack = max(1, min(3, c.words // 12)), 4 + c.words // 8
            # windows over document borders are looked up too: verification reads one document
            if len(s) > n:
                far = c.search(window_prints(s, n, step))
                for i, j, _ in far.tolist():
                    g = int(np.searchsorted(first, i * step + c.words // 2, side="right")) - 1
                    d, a, _ = group[g]
                    at = a + i * step - int(first[g])
                    hits.setdefault((d, number, j), set()).add((at - slack, at + slack))
            for g in np.flatnonzero((size < c.words) & (size >= max(c.k, SIMILARITY * c.words))):
                m = size[g] - c.k + 1     # a document shorter than the window
                for _, j, _ in c.search(fingerprint((s[first[g] + m] - s[first[g]])[None, :], m)).tolist():
                    hits.setdefault((group[g][0], number, j), set()).add((group[g][1] - slack, group[g][1] + slack))
    found: dict = {}
    for (d, number, j), spans in hits.items():
        c = classes[number]
        item, own = c.items[j], words[t.offsets[d]:t.offsets[d + 1]]
        if len(own) < c.k:
            continue
        sim, start = best_window(own, item, c.k, list(spans))
        old = found.get((d, item[0]))
        if sim >= SIMILARITY and (old is None or (-sim, start) < (-old[0], old[1])):
            found[d, item[0]] = (sim, start, min(item[1], len(own)))
    return [(d, i, *v) for (d, i), v in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1])))]


SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def _passes(docs: DataFrame, benchmark: DataFrame, per_pass: int):
    """A broadcast of (classes, keys) for each pass of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    passes = max(1, -(-items.count() // per_pass))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for i in range(passes):
        classes = build(sorted(((r.item_id, r.text) for r in items.where(part == i).collect()),
                               key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))
        yield docs.sparkSession.sparkContext.broadcast((classes, keys_of(classes)))


def contaminated(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS) -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, similarity,
    start_word (from 0) and n_words of the window most like the item."""
    out = None
    for sent in _passes(docs, benchmark, per_pass):

        def rows(batches, sent=sent):
            for b in pieces(batches):
                got = matches(b, *sent.value)
                ids = b.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[g[0]] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                     pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64()),
                     pa.array([g[4] for g in got], pa.int64())],
                    ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns.  Each row is judged by
    its own text, whatever its doc_id; what a pass leaves is staged for the next one."""
    out = None
    for sent in _passes(docs, benchmark, per_pass):

        def rows(batches, sent=sent):
            for b in pieces(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in matches(b, *sent.value)]] = False
                yield b.filter(pa.array(keep))

        out = (docs if out is None else stage(out, "cleaned")).mapInArrow(rows, docs.schema)
    return out
