"""k-means with restarts: kept restart, parts, seeds, rest."""
import numpy as np

from choicekit.operators import kmeans as KM

POINT = "doc_id long, vec_id long, embedding array<double>"


def points(n=60, groups=2, seed=0, width=4, centres=3, spread=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=(centres, width))
        rows += [(g, 1000 * g + i, (c[i % centres] + spread * rng.normal(size=width)).tolist()) for i in range(n)]
    return rows


def run(spark, rows, **kw):
    members, report = KM.kmeans_restarts(spark.createDataFrame(rows, POINT), **kw)
    return ({r.vec_id: (r.cluster, round(r.centre_sim, 9), r.restart) for r in members.collect()},
            {(r.doc_id, r.restart): (r.objective, r.converged, r.kept) for r in report.collect()})


def test_finds_separate_clusters_and_keeps_the_best(spark):
    rows = points() + [(7, 9001, [1.0, 0.0, 0.0, 0.0]), (7, 9002, [0.0, 1.0, 0.0, 0.0]), (None, 9003, [1.0] * 4), (0, 9004, None)]
    got, report = run(spark, rows, k=3, restarts=5)
    assert set(got) == {r[1] for r in rows[:-2]}
    for g in (0, 1):
        mine = {i: {got[1000 * g + j][0] for j in range(i, 60, 3)} for i in range(3)}
        assert all(len(v) == 1 for v in mine.values()) and len(set.union(*mine.values())) == 3
        tries = {r: o for (k, r), (o, _, _) in report.items() if k == g}
        assert len(tries) == 5
        kept = [r for (k, r), (_, _, x) in report.items() if k == g and x]
        assert kept == [min(r for r, o in tries.items() if o == max(tries.values()))]
        assert {got[1000 * g + j][2] for j in range(60)} == set(kept)
        # the objective is what the members say, and they sit with the mean direction of theirs
        assert abs(sum(got[1000 * g + j][1] for j in range(60)) - max(tries.values())) < 1e-6
        x = np.array([r[2] for r in rows if r[0] == g and r[2]])
        x /= np.linalg.norm(x, axis=1)[:, None]
        c = np.array([got[1000 * g + j][0] for j in range(60)])
        means = np.array([x[c == j].sum(axis=0) for j in range(3)])
        means /= np.linalg.norm(means, axis=1)[:, None]
        assert ((x @ means.T).argmax(axis=1) == c).all()
    assert {got[9001][0], got[9002][0]} == {0, 1}      # fewer directions than k
    assert all(conv for _, conv, _ in report.values())


def test_parts_make_no_difference_and_a_stop_shows(spark, monkeypatch):
    rows = points(90, 1, 3, centres=6, spread=0.6)
    whole = run(spark, rows, k=5, restarts=3, max_iter=2)
    monkeypatch.setattr(KM, "PART", 16)
    parted = run(spark, rows, k=5, restarts=3, max_iter=2)
    assert {i: c[0] for i, c in whole[0].items()} == {i: c[0] for i, c in parted[0].items()}
    assert {k: round(v[0], 6) for k, v in whole[1].items()} == {k: round(v[0], 6) for k, v in parted[1].items()}
    assert len({v[0] for v in whole[1].values()}) > 1          # restarts differ
    assert not all(v[1] for v in whole[1].values())            # two steps are too few for some
