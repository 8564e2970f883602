"""Properties of the MLlib-backed queries (rows-only in the oracle)."""
import statistics

from choicekit.plans.registry import queries


def test_global_kmeans_deterministic_and_in_range(spark, sf_dir):
    a = {r.vec_id: r.cluster for r in queries()["cosine_kmeans_global"](spark, sf_dir).collect()}
    b = {r.vec_id: r.cluster for r in queries()["cosine_kmeans_global"](spark, sf_dir).collect()}
    assert a == b and set(a.values()) <= set(range(10)) and len(a) > 0


def test_projection_orders_variance(spark, sf_dir):
    rows = queries()["project_2d"](spark, sf_dir).collect()
    assert all(r.x is not None and r.y is not None for r in rows)
    assert statistics.pvariance([r.x for r in rows]) >= statistics.pvariance([r.y for r in rows])


def test_linear_scorer_threshold_and_range(spark, sf_dir):
    rows = queries()["linear_scorer"](spark, sf_dir).collect()
    assert all(0.0 <= r.prob <= 1.0 for r in rows)
    assert all(r.prediction == (1.0 if r.prob > 0.5 else 0.0) for r in rows if abs(r.prob - 0.5) > 1e-6)
