"""Source divergence audit with a k2-tree (operator 13).

For each language the matrix of sources (rows) by kept terms (columns) holds how often a
source uses a term.  Columns are dealt to tiles by a hash, rows to blocks of ``ROWS``; one
task takes one tile of one pair of blocks and builds its k2-tree (k = 2): a node is a
quadrant with a nonzero cell, and holds four children.  A traversal goes down for all pairs
of rows at once.  Where both quadrants of a pair of nodes are zero, every cell of a row has
the one price of a count of 0, so the quadrant is priced as its number of columns times the
difference of two prices; only nonzero leaves are visited, jointly for both rows.  The
language's own row is in every tile: it gives the columns, and its joint leaves with a
source give the terms that the source overuses.

Prices are exact integers: 1 + floor(1000000000 (count + 5) / (N + 5 V)).

Defined results: null text, lang and source are ''; a document is a row, so repeated rows
count each; a language without kept terms has pairs of value 0; a source without terms has
the price of count 0 everywhere; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tokens, pieces, stage, tokens

MIN_DOCS = 30              # documents of a language that hold a kept term, at least
TOP_TERMS = 50             # ranks of the part `term`
COLUMNS = 768              # kept terms of a tile, about
ROWS = 32                  # sources of a block
SLICE = 4 << 20            # text bytes counted at once
FRONT = 1 << 17            # pairs of nodes expanded at once
SCALE, PRIOR = 10 ** 9, 5

# white space for every byte that is in no term; A-Z in lower case
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[np.r_[0:0x41, 0x5B:0x61, 0x7B:0x80]] = 0x20
_BYTES[0x41:0x5B] += 0x20


def terms(text: pa.Array) -> Tokens:
    """Terms of a slice: runs of ASCII letters and all other non-ASCII characters."""
    t = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(t.buffers()[1], np.int64)[t.offset:t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    data = t.buffers()[2] if len(t) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.Array.from_buffers(pa.large_string(), len(t), [
        None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(_BYTES[raw])])
    return tokens(plain, lower=False)


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, the sums of each array of values within them)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, limit=SLICE):
        k = terms(b.column("text"))
        n_words = max(1, len(k.words))
        row = np.repeat(np.arange(b.num_rows), np.diff(k.offsets))
        in_doc, n = np.unique(row * n_words + k.codes, return_counts=True)
        lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
        group = np.asarray(lang.indices).astype(np.int64) * max(1, len(source.dictionary)) + np.asarray(source.indices)
        key, n, docs = _sums(group[in_doc // n_words] * n_words + in_doc % n_words, n, np.ones(len(n), np.int64))
        g, word = key // n_words, key % n_words
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(g // max(1, len(source.dictionary)))),
             source.dictionary.take(pa.array(g % max(1, len(source.dictionary)))),
             k.words.take(pa.array(word)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            ["lang", "source", "term", "n", "docs"])


def price(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / total), exactly."""
    c, d = np.asarray(count, np.int64) + PRIOR, np.asarray(total, np.int64)
    if len(d) and d.max() >= 1 << 46:  # beyond this the steps below could wrap
        return np.array([1 + SCALE * int(a) // int(b) for a, b in zip(c, d, strict=True)], np.int64)
    whole, rest = np.divmod(c * 10 ** 5, d)
    return 1 + whole * 10 ** 4 + rest * 10 ** 4 // d


class K2Tree:
    """Quadtree of the nonzero cells of a matrix.  ``child[level][node, digit]`` is the
    node one level below, or -1 for a zero quadrant; level 0 holds the cells themselves,
    and ``cell`` maps its nodes to the given cells.  The digit is 2 * row half + column half."""

    def __init__(self, row: np.ndarray, col: np.ndarray, side: int):
        self.height = max(1, (side - 1).bit_length())
        code = np.zeros(len(row), np.int64)
        for bit in range(self.height):
            code |= ((row >> bit & 1) << (2 * bit + 1)) | ((col >> bit & 1) << (2 * bit))
        self.cell = np.argsort(code, kind="stable")
        below = code[self.cell]
        self.child: list[np.ndarray] = [np.zeros((0, 4), np.int32)]
        for _ in range(self.height):
            parents, at = np.unique(below >> 2, return_inverse=True)
            kids = np.full((max(1, len(parents)), 4), -1, np.int32)
            kids[at, below & 3] = np.arange(len(below), dtype=np.int32)
            self.child.append(kids)
            below = parents


def traverse(tree: K2Tree, need: np.ndarray, n_cols: int):
    """Joint traversal for the pairs (r1, r2), r1 < r2, that ``need`` marks.

    Yields ("zero", level, block of r1, block of r2, columns) for pairs of zero quadrants and
    ("leaf", r1, r2, column, node of r1, node of r2) for columns where one is nonzero; a
    missing node is -1."""
    wanted = [need]
    for _ in range(tree.height):
        w = wanted[-1]
        w = np.pad(w, [(0, w.shape[0] % 2), (0, w.shape[1] % 2)])
        wanted.append(w[0::2, 0::2] | w[0::2, 1::2] | w[1::2, 0::2] | w[1::2, 1::2])
    zero = np.zeros(1, np.int32)
    front = [(tree.height, zero, zero, zero, zero, zero)]
    while front:
        level, ia, ib, ra, rb, cb = front.pop()
        if len(ra) > FRONT:
            half = len(ra) // 2
            front += [(level, *(x[:half] for x in (ia, ib, ra, rb, cb))),
                      (level, *(x[half:] for x in (ia, ib, ra, rb, cb)))]
            continue
        kids, below = tree.child[level], level - 1
        out = []
        for digit in range(8):
            x, y, z = digit >> 2, digit >> 1 & 1, digit & 1
            a, b, c = 2 * ra + x, 2 * rb + y, 2 * cb + z
            ok = (a <= b) & (b < wanted[below].shape[1]) & ((c << below) < n_cols)
            ok[ok] = wanted[below][a[ok], b[ok]]
            p, q = ia[ok], ib[ok]
            out.append((np.where(p >= 0, kids[p, 2 * x + z], -1), np.where(q >= 0, kids[q, 2 * y + z], -1),
                        a[ok], b[ok], c[ok]))
        ia, ib, ra, rb, cb = (np.concatenate(o) for o in zip(*out, strict=True))
        void = (ia < 0) & (ib < 0)
        if void.any():
            cols = np.minimum((cb[void] + 1) << below, n_cols) - (cb[void] << below)
            yield "zero", below, ra[void], rb[void], cols
        ia, ib, ra, rb, cb = (v[~void] for v in (ia, ib, ra, rb, cb))
        if not len(ra):
            continue
        if below == 0:
            yield "leaf", ra, rb, cb, ia, ib
        else:
            front.append((below, ia, ib, ra, rb, cb))


_OUT = "lang string, row int, other int, term string, value long"


def _tile(rows_a_block: int, top: int):
    def audit(key: tuple, t: pa.Table) -> pa.Table:
        lang, _, bi, bj = (k.as_py() for k in key)
        head = t.filter(pc.is_null(t["term"]))
        ids = np.asarray(head["row"])
        order = np.argsort(ids)
        ids = ids[order]                              # the language's own row is -1, so first
        total = np.asarray(head["n"])[order] + PRIOR * np.asarray(head["v"])[order]
        cells = t.filter(pc.is_valid(t["term"]))
        row = np.searchsorted(ids, np.asarray(cells["row"]))
        n = np.asarray(cells["n"])
        own = row == 0
        words = pc.take(cells["term"], pa.array(np.flatnonzero(own))).combine_chunks()
        words = words.take(pc.sort_indices(words.cast(pa.binary())))     # by UTF-8 bytes
        term = np.asarray(pc.index_in(cells["term"], words)).astype(np.int64)
        # frequent terms first, so that nonzero cells share quadrants
        use = np.zeros(len(words), np.int64)
        use[term[own]] = n[own]
        by_use = np.lexsort((np.arange(len(words)), -use))
        col = np.argsort(by_use)[term]

        block = ids // rows_a_block
        r = len(ids)
        need = np.zeros((r, r), bool)
        if bi == bj:
            need[np.triu_indices(r, 1)] = True
        else:
            need[np.ix_(block == bi, block == bj)] = True
            need[0] = False
        value = np.zeros((r, r), np.int64)
        found: list[tuple] = []
        if len(words):
            nothing = price(np.zeros(r, np.int64), total)
            tree = K2Tree(row.astype(np.int64), col.astype(np.int64), max(r, len(words)))
            cell_price = price(n, total[row])[tree.cell]
            blocks = [np.zeros((-(-r >> lv), -(-r >> lv)), np.int64) for lv in range(tree.height + 1)]
            for got in traverse(tree, need, len(words)):
                if got[0] == "zero":
                    _, lv, ra, rb, cols = got
                    np.add.at(blocks[lv], (ra, rb), cols)
                    continue
                _, ra, rb, c, ia, ib = got
                pa_, pb = np.where(ia >= 0, cell_price[ia], nothing[ra]), np.where(ib >= 0, cell_price[ib], nothing[rb])
                at, f = _sums(ra.astype(np.int64) * r + rb, np.abs(pa_ - pb))
                value.ravel()[at] += f
                over = (ra == 0) & (ib >= 0) & (pb > pa_)
                found.append((rb[over], c[over], (pb - pa_)[over]))
            same = np.abs(nothing[:, None] - nothing[None, :])
            i = np.arange(r)
            for lv, z in enumerate(blocks):
                value += z[i[:, None] >> lv, i[None, :] >> lv] * same
        a, b = np.nonzero(need)
        a, b = a[a > 0], b[a > 0]
        rows = [ids[a], ids[b], value[a, b]]
        over, c, f = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((by_use[c], -f, over)) if len(c) else np.zeros(0, np.int64)
        over, c, f = over[order], c[order], f[order]
        first = np.searchsorted(over, over)
        keep = np.arange(len(over)) - first < top     # no other can be among the first
        over, c, f = over[keep], c[keep], f[keep]
        return pa.table([
            pa.array([lang] * (len(a) + len(over)), pa.string()),
            pa.array(np.concatenate([rows[0], ids[over]]), pa.int32()),
            pa.array(np.concatenate([rows[1], np.full(len(over), -1)]), pa.int32()),
            pa.concat_arrays([pa.nulls(len(a), pa.string()),
                              words.take(pa.array(by_use[c], pa.int64())).cast(pa.string())]),
            pa.array(np.concatenate([rows[2], f]), pa.int64())],
            ["lang", "row", "other", "term", "value"])
    return audit


def _pair(i, j) -> F.Column:
    return F.named_struct(F.lit("bi"), i, F.lit("bj"), j)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, columns: int = COLUMNS,
          rows: int = ROWS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    d = docs.select(F.col("text").cast("string").alias("text"), *(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    used = stage(d.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
                 .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = stage(used.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
                 .where(F.col("docs") >= min_docs).select("lang", "term", "n"), "kept-terms")
    cells = stage(used.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
                  .select("lang", "source", "term", "n"), "term-cells")

    # a row per language and per source: numbers of rows, tiles and blocks, totals
    langs = d.select("lang").distinct().join(
        kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total")), "lang", "left") \
        .select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    sources = d.select("lang", "source").distinct().join(
        cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    numbered = stage(sources.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
        (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("row")), "audit-rows")
    blocks = numbered.groupBy("lang").agg((F.floor(F.max("row") / rows) + 1).cast("int").alias("blocks"))
    langs = stage(langs.join(blocks, "lang").withColumn(
        "tiles", F.greatest(F.lit(1), F.ceil(F.col("v") / columns)).cast("long")), "audit-langs")

    tile = F.pmod(F.xxhash64("term"), F.col("tiles"))
    block = F.floor(F.col("row") / rows).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    with_each = F.transform(all_blocks, lambda k: _pair(F.least(block, k), F.greatest(block, k)))
    every = F.flatten(F.transform(all_blocks, lambda i: F.transform(
        F.sequence(i, F.col("blocks") - 1), lambda j: _pair(i, j))))
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")
    no_term, no_n = F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("v")
    own = F.lit(-1).alias("row")

    heads = numbered.join(langs.drop("total"), "lang").select(
        "lang", "row", no_term, F.col("total").alias("n"), "v", with_each.alias("at"), tiles)
    own_heads = langs.select("lang", own, no_term, F.col("total").alias("n"), "v", every.alias("at"), tiles)
    marks = cells.join(numbered.drop("total"), ["lang", "source"]).join(langs.drop("total", "v"), "lang").select(
        "lang", "row", "term", "n", no_n, with_each.alias("at"), tile.alias("tile"))
    own_marks = kept.join(langs.drop("total", "v"), "lang").select(
        "lang", own, "term", "n", no_n, every.alias("at"), tile.alias("tile"))
    parts = heads.unionByName(own_heads).unionByName(marks).unionByName(own_marks).select(
        "lang", "tile", F.inline("at"), "row", "term", "n", "v")
    out = stage(parts.groupBy("lang", "tile", "bi", "bj").applyInArrow(_tile(rows, top), _OUT), "audit-tiles")

    name = numbered.select("lang", "row", "source")
    other = name.toDF("lang", "other", "item")
    sums = out.where("term IS NULL").groupBy("lang", "row", "other").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("row", "other"), F.struct(F.col("other").alias("row"), F.col("row").alias("other")))
    both = sums.select("lang", "value", F.inline(ends))
    by = W.partitionBy("lang", "row").orderBy(F.desc("value"), "item")
    pairs = both.join(other, ["lang", "other"]).select("lang", "row", F.lit("pair").alias("part"), "item", "value",
                                                       F.row_number().over(by).alias("rank"))
    over = out.where("term IS NOT NULL").select("lang", "row", F.lit("term").alias("part"), F.col("term").alias("item"),
                                                "value").withColumn("rank", F.row_number().over(by)) \
        .where(F.col("rank") <= top)
    return pairs.unionByName(over).join(name, ["lang", "row"]).select("lang", "source", "part", "item", "value", "rank")
