"""Operators 11 to 13 against brute force and on hard rows."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from choicekit.llm import best_fit, divergence, hard_negatives
from choicekit.llm.encoder import ByteEncoder, WordEncoder
from choicekit.llm.queries import QUERIES

VEC = "vec_id long, embedding array<double>, label int, key string, count long"
DOC = "doc_id long, text string, lang string, source string, n int, row int"


# -- hard negatives ---------------------------------------------------------------------------
def brute_negatives(rows, anchors=100):
    seen = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v)))
    out = []
    for a, la, va in seen:
        if a % anchors:
            continue
        score = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in seen]  # noqa: B905
        pos = sorted(s[:2] for s in score if s[2] == la and s[1] != a)[:5]
        for p, pid in pos:
            neg = sorted(s[:2] for s in score if s[2] != la and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
            out += [(a, pid, r, n[1], -p, -n[0]) for r, n in enumerate(neg, 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **kw).collect())


def clusters(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, width))
    return [(int(i), (centre[c] + spread * rng.normal(size=width)).tolist(), int(c % 10), "x", 1)
            for i, c in enumerate(rng.integers(0, 12, n))]


def test_negatives_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(100 + 3 * i, [1.0, 0.5], i % 2, "x", 1) for i in range(60)]      # one vector, two labels
    rows = same + [(1, None, 1, "x", 1), (2, [None, 1.0], 1, "x", 1), (3, [nan, 1.0], 1, "x", 1),
                   (4, [1.0, inf], 1, "x", 1), (5, [1.0, 1.0], None, None, None), (None, [1.0, 1.0], 1, "x", 1),
                   (6, [0.0, 0.0], 1, "x", 1), (7, [0.99, 0.5], 9, "x", 1), (0, [-1.0, -0.5], 0, "x", 1),
                   (200, [0.0, 0.0], 2, "x", 1), (8, [0.9], 0, "x", 1), (9, [], 1, "x", 1), (300, [-0.001, 0.7], 3, "x", 1),
                   (11, [0.9, 0.4], 3, "x", 1), (11, [0.9, 0.4], 3, "x", 1), (12, [0.9, 0.4], 4, "y", 2)]
    want = brute_negatives(rows)
    assert want and mined(spark.createDataFrame(rows, VEC)) == want


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_equal_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SMALL", 24)      # two levels
    monkeypatch.setattr(hard_negatives, "QUERIES", 16)    # a leaf meets its queries in parts
    rows = clusters(3, 1500, 8, spread)
    rows += [(10_000 + i, rows[0][1], rows[0][2], "x", 1) for i in range(400)]      # a hot vector
    got = mined(spark.createDataFrame(rows, VEC), anchors=20, leaf=32)
    assert got == brute_negatives(rows, 20)


def test_negatives_tree_leaves_out_leaves(spark):
    df = hard_negatives.rows_of(spark.createDataFrame(clusters(5, 4000, 8, 0.02), VEC))
    df = df.withColumn("key", F.unhex(F.sha2(F.col("vec_id").cast("string"), 256))) \
        .withColumn("ids", F.array("vec_id")).withColumn("asked", F.lit(None).cast("binary")) \
        .withColumn("norm2", F.aggregate("ints", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)) \
        .checkpoint()
    tree = hard_negatives.fit(df)
    index = hard_negatives.leaves(df, tree, 64).checkpoint()
    assert index.agg(F.sum("n"), F.max("n")).first()[0] == 4000 and index.agg(F.max("n")).first()[0] <= 64
    top = F.array(F.struct(F.lit(0).alias("w"), (F.col("norm2") * 95 / 100).cast("long").alias("lo"),
                           F.col("norm2").alias("hi")))
    asked = df.where("vec_id % 100 = 0").withColumn("windows", top)
    met = hard_negatives.survivors(asked, tree, index).count()
    assert met < 0.5 * asked.count() * index.count()


def test_negatives_empty(spark):
    assert mined(spark.createDataFrame([], VEC)) == []


# -- packing ------------------------------------------------------------------------------------
def word_ids(texts):
    return [[*e.ids, 1] for e in WordEncoder("word_bpe_49k.json").tok.encode_batch(
        [t or "" for t in texts], add_special_tokens=False)]


def check_packing(rows, out, capacity=4096):
    """Every piece is there with its ids, and sequences are gapless and not too long."""
    want = Counter()
    for (doc_id, *_), ids in zip(rows, word_ids([r[1] for r in rows]), strict=True):
        for k, a in enumerate(range(0, len(ids), capacity)):
            p = np.array(ids[a:a + capacity], "<u4")
            want[doc_id, k, a, len(p), zlib.crc32(p)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    at = defaultdict(int)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values(), default=0) <= capacity
    return len(at), -(-sum(at.values()) // capacity)


HARD = ["áb <|endoftext|> x", "<|EndOfText|> x", "it's 'sam I'LL we'́", "İstanbul ÉCOLE École K",
        "x≠y a≮b y!̸", "foo bar   baz\x85q \x1cw", "", None, "  lead\n\n\ttrail  ",
        "a.b,c;d:e!f?g (h) 'tis don't,́ 12 3a b4 ǅx ſs ŉa ﬁx", "a ́b", "ab\x00c d", "\U0001f600 ok.\U0001f600",
        "so, word. " * 9000, "é" * 5000, "x" * 30_000, "tie " * 99, "tie " * 99]


def test_packing_hard_rows(spark):
    rows = [(None if i == 3 else i, t, None, "a", 1, 1) for i, t in enumerate(HARD)] + [(1, "again", "en", "b", 1, 1)] * 2
    sequences = best_fit.pack(spark.createDataFrame(rows, DOC), chunk=3 * 4096)
    n, least = check_packing(rows, best_fit.digest(sequences).collect())
    assert n <= least + 1


def test_packing_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n, least = check_packing(rows, QUERIES["op12_best_fit"](spark, sf_dir).collect())
    assert n <= 1.01 * least + 1


def test_packing_rounds(spark):
    """Many tasks with little each: what they leave half-filled is packed together."""
    rows = [(i, "word " * (37 * i % 900), "en", "a", 1, 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOC).repartition(40)
    n, least = check_packing(rows, best_fit.digest(best_fit.pack(docs, chunk=20_000)).collect())
    assert n <= 1.01 * least + 1


@pytest.mark.parametrize("low, high", [(1, 4096), (1300, 1300), (1, 60), (2100, 4096), (300, 1500)])
def test_sum_of_squares_fills(low, high):
    length = np.random.default_rng(low).integers(low, high + 1, 2000)
    place, n = best_fit.sum_of_squares(length, 4096)
    filled = np.bincount(place, length)
    assert len(filled) == n and filled.max() <= 4096 and filled.min() > 0
    gaps: list[int] = []                     # best fit decreasing, for comparison
    for s in sorted(length, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(4096 - s)
    assert n <= 1.01 * len(gaps) + 1


def test_sum_of_squares_takes_the_smallest_sum():
    """Each step against all choices tried out."""
    length = np.random.default_rng(1).integers(1, 40, 300)
    place, _ = best_fit.sum_of_squares(length, 64)
    least, gaps = -(-int(length.sum()) // 64), {}

    def squares(g):
        return sum(v * v for v in Counter(x for x in g.values() if 0 < x < 64).values())
    for i in np.argsort(-length, kind="stable"):
        s, to = int(length[i]), int(place[i])
        choices = {k: squares({**gaps, k: g - s}) for k, g in gaps.items() if g >= s}
        if not choices or len(gaps) < least:
            choices[len(gaps)] = squares({**gaps, len(gaps): 64 - s})
        assert choices[to] == min(choices.values())
        gaps[to] = gaps.get(to, 64) - s


def test_packing_empty(spark):
    assert best_fit.digest(best_fit.pack(spark.createDataFrame([], DOC))).collect() == []


@pytest.mark.parametrize("kind, name", [(WordEncoder, "word_bpe_49k.json"), (ByteEncoder, "byte_bpe_50k.json")])
def test_encoder_equals_library(kind, name, spark, sf_dir):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    enc = kind(name)
    want = enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for a in range(0, len(texts), 50):
        got = enc.encode(pa.array(texts[a:a + 50], pa.string()))
        assert [list(g) for g in got] == [e.ids for e in want[a:a + 50]]


# -- divergence ---------------------------------------------------------------------------------
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, min_docs, top):
    used, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        found = [w.translate(LOWER) for w in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        used[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, names in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def prices(count, kept=kept):
            n = sum(count[t] for t in kept)
            return [1 + 10 ** 9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept]
        of = {s: prices(used[lang, s]) for s in names}
        whole = prices(sum((used[lang, s] for s in names), Counter()))
        for s in names:
            pair = sorted((-sum(abs(a - b) for a, b in zip(of[s], of[o], strict=True)), o.encode(), o) for o in names - {s})
            term = sorted((q - p, t.encode(), t) for t, p, q in zip(kept, of[s], whole, strict=True)
                          if used[lang, s][t] and p > q)[:top]
            for part, got in (("pair", pair), ("term", term)):
                out += [(lang, s, part, x[2], -x[0], r) for r, x in enumerate(got, 1)]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


def hard_terms():
    rng = np.random.default_rng(2)
    vocabulary = [f"{a}{b}" for a in "abcdeé中Z" for b in "xyzü\U0001f600"]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)) + "1a_B\x00c", ["en", None, "de"][i % 3], f"s{i % 13}", 1, 1)
            for i in range(400)]
    return rows + [(500, None, None, None, 1, 1), (501, "", "", "", 1, 1), (502, "lonely", "xx", "s1", 1, 1),
                   (503, None, "xx", "s2", 1, 1), (504, "once", "yy", None, 1, 1), (505, "ax", "en", "quiet", 1, 1),
                   (505, "ax", "en", "quiet", 1, 1), (506, "... 12 ", "en", "dumb", 1, 1), (507, "Ax " * 60_000, "de", "s1", 1, 1)]


@pytest.mark.parametrize("columns, rows_a_block", [(768, 32), (7, 32), (5, 3), (1, 1)])
def test_audit_equals_brute_force(spark, columns, rows_a_block):
    rows = hard_terms()
    got = audited(spark.createDataFrame(rows, DOC), min_docs=4, top=6, columns=columns, rows=rows_a_block)
    assert got == brute_audit(rows, 4, 6)


def test_audit_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_divergence"](spark, sf_dir).collect()) == brute_audit(rows, 30, 50)


def test_audit_empty(spark):
    assert audited(spark.createDataFrame([], DOC)) == []


def test_price_is_exact():
    rng = np.random.default_rng(0)
    for bits in (8, 20, 40, 45, 50):
        total = rng.integers(6, 1 << bits, 300)
        count = (total * rng.random(300)).astype(np.int64) // 2
        want = [1 + 10 ** 9 * (int(c) + 5) // int(t) for c, t in zip(count, total, strict=True)]
        assert divergence.price(count, total).tolist() == want


def test_tree_and_traversal():
    rng = np.random.default_rng(4)
    for r, c, share in ((1, 1, 1), (5, 37, 0.1), (21, 64, 0.02), (40, 9, 0.5)):
        m = rng.random((r, c)) < share
        row, col = np.nonzero(m)
        if not len(row):
            row, col = np.array([0]), np.array([0])
            m[0, 0] = True
        tree = divergence.K2Tree(row, col, max(r, c))
        need = np.triu(rng.random((r, r)) < 0.6, 1)
        zero = np.zeros((r, r), np.int64)
        leaves = set()
        for got in divergence.traverse(tree, need, c):
            if got[0] == "zero":
                for a, b, n in zip(got[2], got[3], got[4], strict=True):
                    lv = 1 << got[1]
                    block = zero[a * lv:(a + 1) * lv, b * lv:(b + 1) * lv]
                    block += n
            else:
                for x in zip(*got[1:], strict=True):
                    a, b, k, ia, ib = map(int, x)
                    assert (ia >= 0) == m[a, k] and (ib >= 0) == m[b, k]
                    for i, at in ((ia, a), (ib, b)):
                        assert i < 0 or (row[tree.cell[i]], col[tree.cell[i]]) == (at, k)
                    assert (a, b, k) not in leaves
                    leaves.add((a, b, k))
        for a, b in zip(*np.nonzero(need), strict=True):
            either = m[a] | m[b]
            assert {k for x, y, k in leaves if (x, y) == (a, b)} == set(np.flatnonzero(either))
            assert zero[a, b] == c - either.sum()
