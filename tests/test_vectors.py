"""Similarity, top-k ties (B14), k > n, cosine k-means properties."""
import math

from pyspark.sql import functions as F

from choicekit.operators import cluster as C
from choicekit.operators import similarity as V
from choicekit.plans.fixtures import vector_groups


def groups(spark):
    rows = [(1, 0, [1.0, 0.0], True), (1, 1, [1.0, 0.0], False), (1, 2, [2.0, 0.0], False),
            (1, 3, [0.0, 1.0], False), (1, 4, [0.0, 0.0], False)]
    return spark.createDataFrame(rows, "doc_id long, vec_id long, embedding array<float>, is_pivot boolean")


def test_cosine_and_zero_vector(spark):
    s = {r.vec_id: r.sim for r in V.pivot_similarity(groups(spark)).collect()}
    assert s == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_top_k_ties_lowest_item_and_k_larger_than_n(spark):
    sims = V.pivot_similarity(groups(spark))
    assert [r.vec_id for r in V.top_k(sims, 2).orderBy("rank").collect()] == [1, 2]
    assert V.top_k(sims, 10).count() == 4
    assert V.top_k(sims, 0).count() == 0
    assert V.top_1(sims).first().vec_id == 1


def test_grouped_kmeans_nearest_centre_property(spark):
    pts = []
    for g in range(3):
        for i in range(12):
            a = (i % 3) * 2.0 + 0.05 * i
            pts.append((g, g * 100 + i, [math.cos(a), math.sin(a)]))
    df = spark.createDataFrame(pts, "doc_id long, vec_id long, embedding array<double>")
    out = C.kmeans_grouped(df, k=3, max_iter=5)
    assert out.count() == len(pts)
    # every point sits with the points of its own direction
    got = {r.vec_id: r.cluster for r in out.collect()}
    for g in range(3):
        for i in range(12):
            for j in range(12):
                if i % 3 == j % 3:
                    assert got[g * 100 + i] == got[g * 100 + j]
    # fewer points than k: k_eff = n
    small = spark.createDataFrame([(9, 1, [1.0, 0.0]), (9, 2, [0.0, 1.0])], "doc_id long, vec_id long, embedding array<double>")
    assert {r.cluster for r in C.kmeans_grouped(small, k=5, max_iter=2).collect()} == {0, 1}


def _brute_force_kmeans(points, k, max_iter):
    """Reference implementation in plain Python of the same seeded Lloyd
    iteration: seeds = k lowest ids, rounded cosine, lowest cluster on ties,
    empty clusters keep their centre."""
    def norm(v):
        return math.sqrt(sum(x * x for x in v))

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / max(norm(a) * norm(b), 1e-8), 6)

    out = {}
    by_doc = {}
    for doc, vid, vec in points:
        by_doc.setdefault(doc, []).append((vid, [float(x) for x in vec]))
    for doc, pts in by_doc.items():
        pts.sort()
        centres = [v for _, v in pts[:k]]

        def assign():
            res = {}
            for vid, v in pts:
                sims = [cos(v, c) for c in centres]
                res[vid] = max(range(len(centres)), key=lambda j: (sims[j], -j))
            return res
        for _ in range(max_iter):
            a = assign()
            for j in range(len(centres)):
                members = [v for vid, v in pts if a[vid] == j]
                if members:
                    centres[j] = [sum(col) / len(members) for col in zip(*members)]
        for vid, c in assign().items():
            out[vid] = c
    return out


def test_grouped_kmeans_equals_brute_force(spark, sf_dir):
    cand = vector_groups(spark, sf_dir).where(~F.col("is_pivot"))
    pts = [(r.doc_id, r.vec_id, r.embedding) for r in cand.collect()]
    expect = _brute_force_kmeans(pts, k=3, max_iter=6)
    got = {r.vec_id: r.cluster for r in C.kmeans_grouped(cand, k=3, max_iter=6).collect()}
    assert got == expect
