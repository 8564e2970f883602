"""N-gram Jaccard self-join by partitioned universes (operator 7).

A document's set holds its distinct five-word shingles.  Two sets of sizes
s <= r with Jaccard similarity 0.8 or more differ in at most H = (r + s) // 9
elements.  Sizes fall into bands; in a band the universe of shingles is hashed
into m segments, so a pair that links differs by fewer than ``a_i`` elements in
some segment i whenever the allocations ``a_i`` (0: not looked at, 1: equal
subsets, 2: subsets up to one deletion apart) add up to H + 1.

Index rows hold a key per segment subset, and in every 32nd segment one per
deletion from it.  Counting the rows of each key gives the exact cost of each
unit of allocation.  A key that nobody shares is free; a document whose free
units already reach H + 1 provably has no partner and is gone.  The others buy
the cheapest units still needed.  Documents then meet in groups around the node
that shares most keys with them; groups are compared exactly, by tiles of
bounded size, and what a tile returns is a spanning set of its links, never all
pairs.  Sketches come first: a byte per segment of a set, so that sets that link
cannot differ in too many bytes; the texts of a tile are sent for those documents only
whose sketch allows a link within the tile.  Where a bought key reaches from one group into another, and the sizes on both
sides allow a link, the fewer documents on the two sides join the other group as guests,
so that its tiles compare them too.  Tiles count on the words themselves.

Exact copies collapse first, by a 128-bit digest of the sorted shingle set.  The result
is a class id per row; links themselves are not returned.

Defined results: null or blank text has an empty set and links with nothing;
fewer words than five make one shingle of all words; every row is a document of its own,
also where an id is null or in several rows, and a component has the smallest id of its
rows, or one above all ids where none has an id; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, mix, pieces, split_by_ids, stage, tokens
from .components import components

SHINGLE = 5
DOUBLE_EVERY = 32       # one segment in so many also indexes its one-deletion neighbourhood
TILE = 640              # documents of one side of a group tile
DENSE_OVER = 24         # in a tile, shingles of more documents than this are compared as a matrix


def bands(limit: int = 1 << 31) -> list[int]:
    """Lower ends of the size bands, each at least 1.25 times the last, so that
    partners of similarity 0.8 sit in the same or the next lower band."""
    out = [1]
    while out[-1] < limit:
        out.append(-(-out[-1] * 5 // 4))
        if out[-1] == out[-2]:
            out[-1] += 1
    return out


BANDS = np.array(bands(), np.int64)


def segments(band: int) -> int:
    """Segments of a band: H + 1 for its largest size and that size's largest partner."""
    top = int(BANDS[band + 1]) - 1
    return (top + top * 5 // 4) // 9 + 1


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle fingerprints of each text of a batch."""
    t = tokens(batch.column("text"))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, t.words.to_pylist()), np.uint64, len(t.words))
    w = word[t.codes]
    n = len(w)
    h = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        h = mix(h + w[j:n - SHINGLE + 1 + j] + np.uint64(j + 1)) if len(h) else h
    out = []
    for i in range(batch.num_rows):
        a, b = t.offsets[i], t.offsets[i + 1]
        if b - a >= SHINGLE:
            s = np.sort(h[a:b - SHINGLE + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        elif b > a:
            one = np.array([(b - a) << 40], np.uint64)
            for j in range(a, b):
                one = mix(one + w[j:j + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


ROWS = 128                 # rows of a batch taken up at once where pairs are compared


SKETCH_LEAST = 16       # segments of the smallest sketch


def sketch_size(n: int) -> int:
    """Segments of a sketch: the next power of two from 0.3 times the set size.  Of sets that
    link, the larger has as many segments as the smaller or twice as many, and the smaller
    more than the (r + s) // 9 elements they may differ by, a quarter of its size."""
    m = SKETCH_LEAST
    while 10 * m < 3 * n:
        m *= 2
    return m


def sketch(s: np.ndarray) -> bytes:
    """A byte per segment, the sum of a byte of each shingle in it: sets that differ by d
    shingles have sketches that differ in d bytes at the most.  Its halves add up to the
    sketch of half as many segments."""
    m = sketch_size(len(s))
    at = (s & np.uint64(m - 1)).astype(np.int64)
    return np.bincount(at, (s >> np.uint64(56)).astype(np.float64), m).astype(np.int64).astype(np.uint8).tobytes()


def may_link(n: np.ndarray, sketches: list[bytes], first: int | None) -> np.ndarray:
    """Documents of a tile whose size and sketch allow a link with another one (``first``: as
    in ``tile_edges``).  No link is lost; the words decide."""
    out = np.zeros(len(n), bool)
    side = np.arange(len(n)) >= (first or 0)
    m_of = np.array([len(x) for x in sketches], np.int64)
    for m in np.unique(m_of).tolist():
        small, large = (np.flatnonzero(m_of == x) for x in (m, 2 * m))
        at = np.concatenate([small[np.argsort(n[small], kind="stable")], large[np.argsort(n[large], kind="stable")]])
        x = [np.frombuffer(sketches[i], np.uint8) for i in at]
        x = np.stack([v if len(v) == m else v[:m] + v[m:] for v in x])
        size = n[at]
        for i in range(len(small)):
            end = int(np.searchsorted(size, size[i] * 5 // 4, side="right"))
            j = at[i + 1:end]
            if first is not None:
                other = np.flatnonzero(side[j] != side[at[i]])
                j, y = j[other], x[i + 1:end][other]
            else:
                y = x[i + 1:end]
            if len(j):
                same = np.zeros(len(j), np.int64)
                for c in range(0, m, 1 << 12):           # bounded memory whatever the size
                    equal = np.ascontiguousarray(y[:, c:c + (1 << 12)] == x[i, c:c + (1 << 12)])
                    same += np.bitwise_count(equal.view(np.uint64)).sum(axis=1, dtype=np.int64)
                j = j[same >= m - (n[j] + size[i]) // 9]
                out[j] = True
                out[at[i]] |= len(j) > 0
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, id, n, sketch) sorted by tile and side; returns those that may link."""
    def done(rows):
        a = sum(r[1] == 0 for r in rows)
        keep = may_link(np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], a if a < len(rows) else None)
        return [rows[i][:3] for i in np.flatnonzero(keep).tolist()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                                           pa.array([r[2] for r in out], pa.int64())], ["tile", "side", "id"])

    rows: list = []
    for b in _few(batches):
        out = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and r[0] != rows[-1][0]:
                out += done(rows)
                rows = []
            rows.append(r)
        yield batch(out)
    if rows:
        yield batch(done(rows))
    give_back()


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        sets = shingle_sets(b)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([sketch(s) for s in sets], pa.binary())],
            ["doc_id", "n", "node", "more", "sketch"])


SIZE_STEP = 1.02
SIZE_SPAN = 12          # partners differ by 5 / 4 at the most: fewer than 11.27 steps, 12 classes


def size_class(n: int) -> int:
    """Class of a set size: two sets that link are at most SIZE_SPAN classes apart."""
    return int(np.log(n) / np.log(SIZE_STEP))


def _band_parts(band: int) -> tuple[int, np.uint64, np.ndarray, np.ndarray]:
    """Segments of a band, its salt, and each segment's place and part of the tag."""
    m = segments(band)
    salt = mix(np.array([band * 2654435761 + 977], np.uint64))[0]
    number = np.arange(m, dtype=np.int64)
    return m, salt, mix(number.view(np.uint64) + salt), (number << 3) | (number % DOUBLE_EVERY == 0)


_small_band_parts = lru_cache(64)(_band_parts)      # of sets below a million: some MB in all


def _own_keys(s: np.ndarray, hashed: np.ndarray, band: int, role: int, need: int,
              node: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and tags of one set in one band.  tag: size class << 52 | missing units << 27 |
    segment << 3 | role << 2 | deletion << 1 | the segment has a deletion neighbourhood."""
    m, salt, place, number = (_small_band_parts if BANDS[band] < 1 << 20 else _band_parts)(band)
    doubles = -(-m // DOUBLE_EVERY)
    short = m + doubles - need              # units it can do without
    seg = ((hashed ^ salt) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % m
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, hashed)
    key = mix(total ^ place)
    base = (size_class(len(s)) << 52) | (short << 27) | (role << 2)
    tag = base | number
    sub = seg % DOUBLE_EVERY == 0
    gone = mix((total[seg[sub]] - hashed[sub]) ^ place[seg[sub]])
    return np.concatenate([key, gone]), np.concatenate([tag, base | (seg[sub] << 3) | 3])


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, limit=2 << 20):
        keys, nodes, tags = [], [], []
        for s in shingle_sets(b):
            r = len(s)
            if not r:
                continue
            node = int(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                     np.int64)[0])
            hashed = mix(s)
            band = int(np.searchsorted(BANDS, r, side="right")) - 1
            todo = [(band, 0, 2 * r // 9 + 1)]
            low = int(BANDS[band])
            if band and -(-4 * r // 5) < low:     # smaller partners in the band below
                todo.append((band - 1, 1, (r + low - 1) // 9 + 1))
            for bd, role, need in todo:
                k, t = _own_keys(s, hashed, bd, role, need, node)
                keys.append(k)
                tags.append(t)
                nodes.append(np.full(len(k), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(tags)),
                 pa.array(np.concatenate(nodes))], ["key", "tag", "node"])


def word_shingles(text: str | None) -> set:
    """The set of a text on its words themselves; verification uses nothing else."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < SHINGLE else set(zip(*(w[i:] for i in range(SHINGLE)),
                                                       strict=False))


def tile_edges(ids: np.ndarray, texts: list, first: int | None) -> list[tuple[int, int]]:
    """Spanning links of one tile.  ``first``: documents before it form one side, the rest
    the other; None: one block against itself.  Shingles of many documents are counted as
    a matrix product, the others pair by pair of the few documents that hold them."""
    n = len(ids)
    number: dict = {}
    docs: list[np.ndarray] = []
    for t in texts:
        docs.append(np.fromiter((number.setdefault(x, len(number)) for x in word_shingles(t)),
                                np.int64))
    del number
    size = np.array([len(d) for d in docs], np.int64)
    row = np.repeat(np.arange(n), size)
    col = np.concatenate(docs) if n else np.zeros(0, np.int64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    held = np.bincount(col) if len(col) else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(held)])
    both = np.zeros((n, n), np.float32)
    many = np.flatnonzero(held > DENSE_OVER)
    for c in range(0, len(many), 1024):
        x = np.zeros((n, len(many[c:c + 1024])), np.float32)
        for k, s in enumerate(many[c:c + 1024]):
            x[row[start[s]:start[s + 1]], k] = 1
        both += x @ x.T
    for k in range(2, DENSE_OVER + 1):
        some = np.flatnonzero(held == k)
        if len(some):
            d = row[start[some][:, None] + np.arange(k)]
            for i in range(k):
                for j in range(i):
                    np.add.at(both, (d[:, i], d[:, j]), 1)
                    np.add.at(both, (d[:, j], d[:, i]), 1)
    union = size[:, None] + size[None, :] - both
    link = (both > 0) & (100 * both >= 80 * union)
    np.fill_diagonal(link, False)
    if first is not None:
        link[:first, :first] = False
        link[first:, first:] = False
    label = np.arange(n)
    while True:                                  # smallest index reachable
        best = np.where(link, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[label[i]])) for i in range(n) if label[i] != i]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few rows: only their texts become Python strings at once."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, id, text) sorted by tile and side; a tile may span batches."""
    def done(rows):
        ids = np.array([r[2] for r in rows], np.int64)
        a = sum(r[1] == 0 for r in rows)
        return tile_edges(ids, [r[3] for r in rows], a if a < len(rows) else None)

    rows: list = []
    for b in _few(batches):
        out = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and r[0] != rows[-1][0]:
                out += done(rows)
                rows = []
            rows.append(r)
        yield _edges(out)
    if rows:
        yield _edges(done(rows))
    give_back()


def _edges(pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                       pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def segment_costs(shared: DataFrame) -> DataFrame:
    """c1, c2 of the segments that aren't free: documents met by looking for an equal subset,
    and those more that one deletion reaches."""
    return shared.groupBy("node", "role", "seg", "dbl", "short").agg(
        F.max(F.when(F.col("gone") == 0, F.col("n_own") - F.when(F.col("role") == 0, 1).otherwise(0))
              .otherwise(0)).alias("c1"),
        F.sum(F.when(F.col("gone") == 1, F.col("n_own")).when(F.col("dbl") == 1, F.col("n_gone"))
              .otherwise(0)).alias("c2")).where("c1 > 0 OR (dbl = 1 AND c2 > 0)")


def allocate(costs: DataFrame) -> DataFrame:
    """The cheapest units each (node, role) still has to buy: (node, role, seg, unit)."""
    units = costs.select("node", "role", "seg", "short", F.explode(F.filter(F.array(
        F.struct(F.lit(1).alias("unit"), F.col("c1").alias("cost")),
        F.struct(F.lit(2).alias("unit"),
                 F.when(F.col("dbl") == 1, F.col("c1") + F.col("c2")).otherwise(0).alias("cost"))),
        lambda u: u["cost"] > 0)).alias("u"))
    w = W.partitionBy("node", "role")
    return units.select("*", F.row_number().over(w.orderBy("u.cost", "seg", "u.unit")).alias("k"),
                        F.count("*").over(w).alias("paid")) \
        .where("k <= paid - short").select("node", "role", "seg", F.col("u.unit").alias("unit"))


def guests(buys: DataFrame, index: DataFrame) -> DataFrame:
    """(center, node): what groups get from others.  Where buyers of one group reach index
    rows of another by a key, the side with fewer of them joins the other's group, whose
    tiles then compare both; keys meet group by group, so no pair of documents is listed.
    With size classes (column ``size``), groups and documents too small or too large for a
    link with the other side stay where they are."""
    if "size" not in buys.columns:
        buys, index = buys.withColumn("size", F.lit(0)), index.withColumn("size", F.lit(0))
    b = buys.groupBy("key", "side", "center").agg(
        F.count("*").alias("nb"), F.min("size").alias("b_low"), F.max("size").alias("b_high"))
    i = index.groupBy("key", "side", "home").agg(
        F.count("*").alias("ni"), F.min("size").alias("i_low"), F.max("size").alias("i_high"))
    both = stage(b.join(i.hint("merge"), ["key", "side"]).where(
        f"center <> home AND i_low <= b_high + {SIZE_SPAN} AND b_low <= i_high + {SIZE_SPAN}"), "groups")
    way = both.groupBy("center", "home").agg((F.sum("ni") <= F.sum("nb")).alias("come"))
    both = stage(both.drop("nb", "ni").join(way.hint("merge"), ["center", "home"]), "groups")
    come = index.join(both.where("come").hint("merge"), ["key", "side", "home"]) \
        .where(f"size BETWEEN b_low - {SIZE_SPAN} AND b_high + {SIZE_SPAN}").select("center", F.col("other").alias("node"))
    go = buys.join(both.where("NOT come").hint("merge"), ["key", "side", "center"]) \
        .where(f"size BETWEEN i_low - {SIZE_SPAN} AND i_high + {SIZE_SPAN}").select(F.col("home").alias("center"), "node")
    some = come.union(go).distinct()
    return some.union(some.select("center", F.col("center")).distinct())     # a group may be one document


def one_row_each(docs: DataFrame, id_col: str, new: str) -> tuple[DataFrame, DataFrame | None, int | None]:
    """``docs`` with a column ``new`` that no two rows share: the id as a long, or for rows
    whose id is null or repeated a number above all ids; these rows (None: there are none),
    and the largest id."""
    docs = docs.withColumn(new, F.col(id_col).cast("long"))
    again = stage(docs.groupBy(new).count().where(F.col(new).isNull() | (F.col("count") > 1)).select(new), "again")
    if again.isEmpty():
        return docs, None, None
    top = docs.agg(F.coalesce(F.max(new), F.lit(-1).cast("long"))).first()[0]
    known = docs.where(F.col(new).isNotNull())
    maybe, never = split_by_ids(known, again.where(F.col(new).isNotNull()), new)
    odd = docs.where(F.col(new).isNull()).union(maybe.join(again.hint("merge"), new, "left_semi").select(*docs.columns))
    # staged, so the numbers stay what they are; an overflow is an error
    odd = stage(odd.withColumn(new, F.lit(top + 1).cast("long") + F.monotonically_increasing_id()), "named")
    plain = never.union(maybe.join(again.hint("merge"), new, "left_anti").select(*never.columns))
    return plain.select(*docs.columns).union(odd.select(*docs.columns)), odd, top


def with_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("real"), F.col(text_col).alias("text"))
    rows, odd, top = one_row_each(docs, "real", "doc_id")
    out = _with_components(rows.select("doc_id", "text"))
    if odd is None:
        return out
    own = odd.select("doc_id", "real").hint("merge")
    out = stage(out.join(own, "doc_id", "left").withColumn(
        "id", F.when(F.col("doc_id") <= top, F.col("doc_id")).otherwise(F.col("real"))), "by-row")
    least = out.groupBy("component_id").agg(F.min("id").alias("least")).hint("merge")
    return out.join(least, "component_id").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("least", "component_id").alias("component_id"))


def _with_components(docs: DataFrame) -> DataFrame:
    base = stage(docs.mapInArrow(_node_rows, "doc_id long, n long, node long, more long, sketch binary"), "nodes")
    full = base.where("n > 0")
    reps = full.groupBy("node", "more").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    # copies beyond each node's representative produce no signatures
    copies = full.join(reps.select("node", "more", F.col("rep").alias("doc_id")), ["node", "more", "doc_id"],
                       "left_anti").select("doc_id").distinct()
    copies = stage(copies, "copies")
    maybe, never = split_by_ids(docs, copies, "doc_id")
    single = never.union(maybe.join(copies, "doc_id", "left_anti"))
    # in this order what the rows of a document have in common is one run of bytes
    rows = single.mapInArrow(_signature_rows, "key long, tag long, node long")
    key = W.partitionBy("key")
    kind = F.col("tag").bitwiseAND(F.lit(7))                       # role, deletion, double
    own, gone = kind.isin(0, 1), kind == 3
    shared = rows.select(
        "*", F.count("*").over(key).alias("n_all"),
        F.sum(F.when(own, 1).otherwise(0)).over(key).alias("n_own"),
        F.sum(F.when(gone, 1).otherwise(0)).over(key).alias("n_gone")) \
        .where("n_all > 1 AND n_own > 0") \
        .select("key", "node", "n_own", "n_gone",
                F.shiftright("tag", 52).cast("int").alias("size"),
                F.shiftright("tag", 27).bitwiseAND(F.lit((1 << 25) - 1)).alias("short"),
                F.shiftright("tag", 3).bitwiseAND(F.lit((1 << 24) - 1)).alias("seg"),
                F.shiftright(kind, 2).alias("role"),
                F.shiftright(kind, 1).bitwiseAND(F.lit(1)).alias("gone"),
                kind.bitwiseAND(F.lit(1)).alias("dbl"))
    shared = stage(shared, "shared")
    costs = stage(segment_costs(shared), "costs")
    bought = stage(allocate(costs), "bought")

    # groups: the index node of each key that shares most, and each buyer's commonest one
    plain = shared.where("gone = 0")
    weight = plain.where("role = 0").groupBy("node").agg(F.sum("n_own").alias("w")).hint("merge")
    buyer = bought.select("node", "role").distinct().hint("merge")
    heavy = plain.where("role = 0").join(weight, "node").groupBy("key").agg(
        F.max(F.struct("w", "node")).alias("top"))
    star = plain.select("key", "node", "role").join(buyer, ["node", "role"]) \
        .join(heavy.select("key", F.col("top.node").alias("center")).hint("merge"), "key") \
        .where("node <> center").groupBy("node", "role", "center").count() \
        .groupBy("node", "role").agg(F.max_by("center", F.struct("count", "center")).alias("center"))
    star = stage(star, "star")
    # a centre shares more than its node, so following centres ends at the root of a group
    for _ in range(2):
        up = star.where("role = 0").select(F.col("node").alias("center"), F.col("center").alias("up")).hint("merge")
        star = stage(star.join(up, "center", "left").select(
            "node", "role", F.coalesce("up", "center").alias("center")), "star")
    member = star.select("center", "node").union(star.select("center", F.col("center"))).distinct()

    # bought keys: who buys them, in which group, and the index rows they reach
    center = star.hint("merge")
    bought = bought.join(shared.select("key", "node", "role", "seg", "gone", "n_gone", "size").hint("merge"), ["node", "role", "seg"]) \
        .where("(unit = 1 AND gone = 0) OR (unit = 2 AND (gone = 1 OR n_gone > 0))")
    buys = stage(bought.join(center, ["node", "role"], "left").select(
        "key", ((F.col("unit") == 2) & (F.col("gone") == 0)).cast("int").alias("side"), "node", "size",
        F.coalesce("center", "node").alias("center")).distinct(), "buys")
    home = star.where("role = 0").select(F.col("node").alias("other"), F.col("center").alias("home")).hint("merge")
    index = stage(shared.where("role = 0").select("key", F.col("gone").cast("int").alias("side"), F.col("node").alias("other"), "size")
                  .join(buys.select("key", "side").distinct().hint("merge"), ["key", "side"], "left_semi")
                  .join(home, "other", "left").withColumn("home", F.coalesce("home", "other")), "index")
    member = stage(member.union(guests(buys, index)).distinct(), "member")
    wanted = member.select("node").distinct() \
        .join(reps.select("node", "rep").hint("merge"), "node").select("node", F.col("rep").alias("doc_id"))
    wanted = stage(wanted, "wanted")
    blocks = member.groupBy("center").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("nb"))
    block = F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int")
    tiles = member.join(blocks.hint("merge"), "center").withColumn("i", block) \
        .select("center", "node", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j")) \
        .select(F.xxhash64("center", F.least("i", "j"), F.greatest("i", "j")).alias("tile"),
                F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "node")
    drawn, _ = split_by_ids(base.select("doc_id", "n", "sketch"), wanted, "doc_id")
    drawn = drawn.join(wanted.hint("merge"), "doc_id")
    drawn = tiles.join(drawn.hint("merge"), "node").select("tile", "side", F.col("doc_id").alias("id"), "n", "sketch") \
        .repartition(F.col("tile")).sortWithinPartitions("tile", "side", "id")
    near = stage(drawn.mapInArrow(_near, "tile long, side int, id long"), "near")
    maybe, _ = split_by_ids(docs, near.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    tiled = maybe.join(near.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id") \
        .select("tile", "side", F.col("doc_id").alias("id"), "text") \
        .repartition(F.col("tile")).sortWithinPartitions("tile", "side", "id")
    links = stage(tiled.mapInArrow(_tiles, "a long, b long"), "links")

    comp = components(links)
    per_node = reps.drop("n").join(comp.hint("merge"), reps["rep"] == comp["id"]).select("node", "more", "component")
    return base.join(reps.drop("n").hint("merge"), ["node", "more"], "left") \
        .join(per_node.hint("merge"), ["node", "more"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")), "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that of its smallest doc_id (a null id last).
    Documents without words all stay."""
    rows, odd, top = one_row_each(docs, "doc_id", "__row")
    found = _with_components(rows.select(F.col("__row").alias("doc_id"), "text"))
    if odd is None:
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__row"))
    else:
        own = odd.select(F.col("__row").alias("doc_id"), F.col("doc_id").cast("long").alias("real")).hint("merge")
        found = stage(found.join(own, "doc_id", "left").withColumn(
            "id", F.when(F.col("doc_id") <= top, F.col("doc_id")).otherwise(F.col("real"))), "found")
        first = found.groupBy("component_id").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first")).hint("merge")
        gone = found.join(first, "component_id").where(F.col("first.doc_id") != F.col("doc_id")) \
            .select(F.col("doc_id").alias("__row"))
    gone = stage(gone, "gone")
    maybe, never = split_by_ids(rows, gone, "__row")
    stay = maybe.join(gone.hint("merge"), "__row", "left_anti")
    return never.select(*docs.columns).union(stay.select(*docs.columns))
