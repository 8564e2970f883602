"""Metrics: softmax normalisation, stable BCE, argmax ties, accuracy by item
(B12), early stop and best checkpoint with explicit modes (B10, B11)."""
import math

from pyspark.sql import functions as F

from choicekit.operators import metrics as M


def preds(spark):
    rows = [(1, 0, 2.0, 0, "a"), (1, 1, 2.0, 1, "a"), (1, 2, -1.0, 0, "a"),
            (2, 0, 800.0, 1, "b"), (2, 1, 799.0, 0, "b")]
    return spark.createDataFrame(rows, "item_id long, choice_idx long, logit double, label int, split string")


def test_softmax_sums_to_one_and_is_stable(spark):
    s = M.softmax(preds(spark)).groupBy("item_id").agg(F.sum("prob").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-12 for r in s)


def test_argmax_lowest_choice_on_ties(spark):
    a = {r.item_id: (r.pred_choice, r.gold_choice) for r in M.argmax_choice(preds(spark)).collect()}
    assert a == {1: (0, 1), 2: (0, 0)}


def test_item_accuracy_groups_by_item_not_batch(spark):
    acc = M.item_accuracy(preds(spark)).first()
    assert (acc.n_items, acc.n_correct, acc.accuracy) == (2, 1, 0.5)


def test_bce_matches_definition(spark):
    x, y = 0.3, 1.0
    r = spark.range(1).select(M.bce_with_logits(F.lit(x), F.lit(y)).alias("b")).first().b
    expect = -(y * math.log(1 / (1 + math.exp(-x))) + (1 - y) * math.log(1 - 1 / (1 + math.exp(-x))))
    assert abs(r - expect) < 1e-12


def test_cross_entropy(spark):
    ce = M.cross_entropy(preds(spark)).first()
    lse1 = math.log(2 * math.exp(2.0) + math.exp(-1.0))
    lse2 = 800 + math.log(1 + math.exp(-1))
    assert abs(ce.cross_entropy - ((lse1 - 2.0) + (lse2 - 800)) / 2) < 1e-9


def runs(spark):
    losses = [1.0, 0.9, 0.95, 0.92, 0.91, 0.8]
    rows = [(1, e, l, round(1 / (1 + l), 6), 10, f"c{e}") for e, l in enumerate(losses)]
    return spark.createDataFrame(rows, "run_id long, epoch long, val_loss double, "
                                       "val_accuracy double, n long, checkpoint string")


def test_early_stop_patience(spark):
    r = M.early_stop_epoch(runs(spark), patience=3).first()
    assert r.stop_epoch == 4          # best at epoch 1, three epochs without improvement
    assert M.early_stop_epoch(runs(spark), patience=5).first().stop_epoch is None


def test_best_checkpoint_modes(spark):
    r = M.best_checkpoint(runs(spark)).first()
    assert r.best_loss_checkpoint == "c5" and r.best_accuracy_checkpoint == "c5"


def test_training_budget(spark):
    items = spark.createDataFrame([("train",)] * 37 + [("test",)] * 5, "split string")
    b = {r.split: (r.total_steps, r.warmup_steps) for r in M.training_budget(items).collect()}
    assert b == {"train": (int(37 / 4 / 4 * 10), int(int(37 / 4 / 4 * 10) * 0.1)),
                 "test": (int(5 / 16 * 10), 0)}


def test_early_stop_over_blocks_equals_a_loop(spark):
    """Runs longer than a block, with gaps, ties and nulls in the monitored value."""
    import random
    rng = random.Random(5)
    rows = []
    for run in range(12):
        epochs = sorted(rng.sample(range(200), rng.randrange(1, 90)))
        rows += [(run, e, None if rng.random() < 0.05 else rng.choice([0.1, 0.2, 0.3, 0.5, 1.0]) + run * 0.0) for e in epochs]
    df = spark.createDataFrame(rows, "run_id long, epoch long, val_loss double")
    for mode, better in (("min", lambda a, b: a < b), ("max", lambda a, b: a > b)):
        want = {}
        for run in range(12):
            best = last = stop = None
            for _, e, v in sorted(r for r in rows if r[0] == run):
                if best is None or (v is not None and better(v, best)):
                    last = e
                if v is not None and (best is None or better(v, best)):
                    best = v
                if stop is None and last is not None and e - last >= 3:
                    stop = e
            want[run] = stop
        for block in (4, 4096):
            got = {r.run_id: r.stop_epoch for r in M.early_stop_epoch(df, 3, mode=mode, block=block).collect()}
            assert got == want
