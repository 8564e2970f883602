"""The item-level scorer against a plain Newton iteration on the same choices."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from choicekit.operators import choice_scorer as CS
from choicekit.operators import metrics as M

CHOICE = "item_id long, choice_idx long, x array<double>, label int, split string"
TRUE = np.array([1.0, -2.0, 0.5])


def items(n, seed=0, choices=(2, 6)):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=(int(rng.integers(*choices)), 3))
        z = x @ TRUE + rng.gumbel(size=len(x))
        rows += [(i, c, v.tolist(), int(c == z.argmax()), "train" if i % 4 else "test") for c, v in enumerate(x)]
    return rows


def plain_fit(rows, penalty=1e-3):
    by = {}
    for i, _, x, y, _ in rows:
        if y is not None and x is not None:
            by.setdefault(i, []).append((x, y))
    groups = [(np.array([c[0] for c in g]), np.array([c[1] for c in g], float)) for g in by.values()]
    groups = [g for g in groups if g[1].sum() > 0]
    w = np.zeros(3)
    for _ in range(60):
        g, h = penalty * len(groups) * w, penalty * len(groups) * np.eye(3)
        for x, y in groups:
            p = np.exp(x @ w - (x @ w).max())
            p /= p.sum()
            k = y.sum()
            g = g + x.T @ (k * p - y)
            h = h + k * ((x * p[:, None]).T @ x - np.outer(p @ x, p @ x))
        w = w - np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("whole", [1000, 3])
def test_fit_equals_plain_newton(spark, monkeypatch, whole):
    monkeypatch.setattr(CS, "WHOLE", whole)         # 3: items of more choices have several rows
    rows = items(200) + [(900, 0, [1.0, 1.0, 1.0], 0, "train"), (900, 1, [2.0, 0.0, 1.0], 0, "train"),
                         (901, 0, [5.0, 5.0, 5.0], 1, "train"),                   # one choice: no information
                         (902, 0, [1.0, 0.0, 0.0], 1, "train"), (902, 1, [0.0, 1.0, 0.0], 1, "train"),
                         (903, 0, None, 1, "train"), (903, 1, [0.0, 0.0, 1.0], None, "train")]
    model = CS.fit_choice_scorer(spark.createDataFrame(rows, CHOICE), "item_id")
    assert np.allclose(model.weights, plain_fit(rows), atol=1e-6)
    assert model.n_items == 202


def test_fit_learns_and_reports(spark):
    df = spark.createDataFrame(items(600, 1, (4, 5)), CHOICE)
    model = CS.fit_choice_scorer(df.where("split = 'train'"), "item_id")
    assert np.abs(model.weights / np.linalg.norm(model.weights) - TRUE / np.linalg.norm(TRUE)).max() < 0.15
    report = {r.split: r for r in M.evaluate(CS.score_choices(df, model.weights)).collect()}
    blind = {r.split: r for r in M.evaluate(CS.score_choices(df, np.zeros(3))).collect()}
    for split in ("train", "test"):
        assert report[split].accuracy > 0.6 and report[split].cross_entropy < blind[split].cross_entropy - 0.3
    assert abs(report["train"].cross_entropy - model.loss) < 1e-6


def test_one_item_of_many_choices(spark):
    rng = np.random.default_rng(2)
    rows = [(1, c, rng.normal(size=3).tolist(), int(c % 5 == 0), "train") for c in range(3000)] + items(40, 3)
    df = spark.createDataFrame(rows, CHOICE)
    assert CS.gather(df, "item_id", "x", "label").agg(F.max("n")).first()[0] < 1300
    assert np.allclose(CS.fit_choice_scorer(df, "item_id").weights, plain_fit(rows), atol=1e-6)


def test_no_items(spark):
    model = CS.fit_choice_scorer(spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0], 0, "a")], CHOICE), "item_id")
    assert model.n_items == 0 and not model.weights.any()
