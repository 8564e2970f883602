"""Property tests against brute force: per-key top-k / top-1, keep-first
de-duplication, early stop, separator segments."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from choicekit.operators import encode as N
from choicekit.operators import joins as J
from choicekit.operators import metrics as M
from choicekit.operators import similarity as V

SET = settings(max_examples=8, deadline=None, derandomize=True,
               suppress_health_check=list(HealthCheck))


@SET
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3).map(lambda x: x / 4)),
                min_size=1, max_size=40), st.integers(0, 5))
def test_top_k_and_top_1(spark, rows, k):
    data = [(key, item, sim) for item, (key, sim) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, vec_id long, sim double")
    got = sorted((r.doc_id, r.rank, r.vec_id) for r in V.top_k(df, k).collect())
    expect = []
    for key in {d[0] for d in data}:
        ranked = sorted((d for d in data if d[0] == key), key=lambda d: (-d[2], d[1]))[:k]
        expect += [(key, i + 1, d[1]) for i, d in enumerate(ranked)]
    assert got == sorted(expect)
    top1 = {r.doc_id: r.vec_id for r in V.top_1(df).collect()}
    assert top1 == {key: min((d for d in data if d[0] == key), key=lambda d: (-d[2], d[1]))[1]
                    for key in {d[0] for d in data}}


@SET
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1000)), min_size=1, max_size=40,
                unique_by=lambda t: t[1]))
def test_dedup_keep_first(spark, rows):
    df = spark.createDataFrame([(k, o, f"v{o}") for k, o in rows], "k long, o long, v string")
    got = {r.k: r.v for r in J.dedup_keep_first(df, "k", "o").collect()}
    assert got == {k: f"v{min(o for kk, o in rows if kk == k)}" for k in {k for k, _ in rows}}


@SET
@given(st.lists(st.integers(0, 9), min_size=1, max_size=15), st.integers(1, 4))
def test_early_stop(spark, losses, patience):
    rows = [(1, e, float(x), 0.0, 1, f"c{e}") for e, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "run_id long, epoch long, val_loss double, "
                                     "val_accuracy double, n long, checkpoint string")
    got = M.early_stop_epoch(df, patience=patience).first().stop_epoch
    best, last, expect = None, None, None
    for e, x in enumerate(losses):
        if best is None or x < best:
            best, last = x, e
        if e - last >= patience:
            expect = e
            break
    assert got == expect


@SET
@given(st.lists(st.lists(st.sampled_from([5, 7, 9, 102]), max_size=8), min_size=1, max_size=10))
def test_segments_and_rejects(spark, seqs):
    rows = [(i, [101] + s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    segs, rej = N.split_segments(df)
    got = {r.doc_id: (r.segment_0, r.segment_1) for r in segs.collect()}
    got_rej = {r.doc_id: r.n_separators for r in rej.collect()}
    for i, ids in rows:
        seps = [p for p, x in enumerate(ids) if x == 102]
        if len(seps) != 2:
            assert got_rej[i] == len(seps) and i not in got
            continue
        L = len(ids)
        a = ids[1:seps[0]]
        b = ids[seps[0] + 1:seps[1]]
        assert got[i] == ((a + [0] * L)[:L], (b + [0] * L)[:L])


@SET
@given(st.lists(st.tuples(st.lists(st.text(alphabet="ab ", max_size=4), min_size=0, max_size=5),
                          st.sampled_from(["A", "B", "C", "D", "E", "", "a"])),
                min_size=1, max_size=15))
def test_binarise_by_letter(spark, items):
    from choicekit.operators import reshape as R
    rows = [(i, "q", opts, ans, "ctx", "train") for i, (opts, ans) in enumerate(items)]
    df = spark.createDataFrame(rows, "example_id long, question string, options array<string>, "
                                     "answer string, article string, split string")
    got = sorted((r.example_id, r.choice_idx, r.answer, r.correct)
                 for r in R.binarise_by_letter(df).collect())
    letters = {"A": 0, "B": 1, "C": 2, "D": 3}
    expect = sorted((i, p, o, int(p == letters.get(a, -1)))
                    for i, (opts, a) in enumerate(items) for p, o in enumerate(opts))
    assert got == expect


@SET
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcé 1.,", max_size=20)),
                min_size=1, max_size=20),
       st.lists(st.text(alphabet="abcé", min_size=2, max_size=3), max_size=6, unique=True))
def test_dictionary_translate(spark, texts, known):
    import regex
    from choicekit.operators import udf as U
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    d = spark.createDataFrame([(w, w.upper()) for w in known] or [("zz", "ZZ")],
                              "src string, tgt string")
    got = {r.k: r.o for r in U.dictionary_translate(df, "k", "t", "o", d).collect()}
    table = {w: w.upper() for w in known}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] is None
        else:
            words = regex.findall(r"[\p{L}\p{N}_]{2,}", t.lower())
            assert got[k] == " ".join(table.get(w, w) for w in words)


@SET
@given(st.lists(st.lists(st.integers(-3, 3).map(float), min_size=3, max_size=3),
                min_size=2, max_size=8))
def test_pivot_similarity(spark, vecs):
    import math
    rows = [(1, i, v, i == 0) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "doc_id long, vec_id long, embedding array<double>, "
                                     "is_pivot boolean")
    got = {r.vec_id: r.sim for r in V.pivot_similarity(df).collect()}
    p = vecs[0]
    np_ = math.sqrt(sum(x * x for x in p))
    for i, v in enumerate(vecs[1:], start=1):
        nv = math.sqrt(sum(x * x for x in v))
        expect = round(sum(a * b for a, b in zip(v, p)) / max(nv * np_, 1e-8), 6)
        assert got[i] == expect


def test_best_match_in_blocks_equals_a_loop(spark, monkeypatch):
    """Blocks of three vectors, ties, concepts without candidates and a null concept."""
    import math
    import random

    from choicekit.operators import entities as E
    monkeypatch.setattr(E, "BLOCK", 3)
    rng = random.Random(2)
    vecs = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(30)] + [(30, [0.0] * 3)]
    ents = [(100 + i, rng.choice(["a", "B ", "c"]), f"l{i}", None, rng.randrange(31)) for i in range(40)]
    asked = [(i, rng.choice(["A", "b", "c", "none", None]), rng.randrange(31)) for i in range(80)]
    got = {r.query_id: (r.entity_id, r.sim) for r in E.best_match(
        spark.createDataFrame(asked, "query_id long, concept string, pivot_vec_id long"),
        spark.createDataFrame(ents, "entity_id long, search_term string, label string, description string, vec_id long"),
        spark.createDataFrame(vecs, "vec_id long, embedding array<double>")).collect()}
    by = dict(vecs)

    def sim(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / max(n, 1e-8), 6)
    for q, c, p in asked:
        hits = [(-sim(by[v], by[p]), e) for e, t, _, _, v in ents if c and t.strip().lower() == c.lower()]
        assert got[q] == ((min(hits)[1], -min(hits)[0]) if hits else (None, None))


def test_best_match_makes_its_blocks_of_ids(spark, monkeypatch):
    """Vectors join their rows after the blocks are made, and repeated vectors change nothing."""
    from choicekit.operators import entities as E
    seen, plain = [], E._in_blocks

    def in_blocks(rows, *names):
        seen.append(set(rows.columns))
        return plain(rows, *names)
    monkeypatch.setattr(E, "_in_blocks", in_blocks)
    got = E.best_match(
        spark.createDataFrame([(1, "a", 0), (2, "a", 1)], "query_id long, concept string, pivot_vec_id long"),
        spark.createDataFrame([(7, "a", "x", None, 0), (8, "a", "y", None, 1)],
                              "entity_id long, search_term string, label string, description string, vec_id long"),
        spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])] * 2, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r.entity_id, r.sim) for r in got) == [(1, 7, 1.0), (2, 8, 1.0)]
    assert len(seen) == 2 and not any(c in cols for cols in seen for c in ("vec", "norm", "embedding"))
