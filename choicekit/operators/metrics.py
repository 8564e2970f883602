"""Scores and evaluation over prediction tables.

Prediction table, long form: ``item_id, choice_idx, logit, label`` (+ split).
Per-item normalisers (max, sum of exponentials) are grouped aggregates joined
back on the item key: they combine map-side, and AQE broadcasts the per-item
table when it is small or splits a hot item on the join when it is not.
Argmax is a ``max_by`` aggregate with the lowest choice winning ties.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x) -> Column:
    """M3."""
    x = F.col(x) if isinstance(x, str) else x
    return 1 / (1 + F.exp(-x))


def bce_with_logits(x, y) -> Column:
    """M4 per row, numerically stable: max(x,0) - x*y + log(1 + exp(-|x|))."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def log_softmax_terms(pred: DataFrame, item: str = "item_id",
                      logit: str = "logit") -> DataFrame:
    """Adds ``_m`` (per-item max) and ``lse`` (log-sum-exp) to every row."""
    m = pred.groupBy(item).agg(F.max(logit).alias("_m"))
    with_m = pred.join(m, item)
    z = with_m.groupBy(item).agg(F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_z"))
    return with_m.join(z, item).withColumn("lse", F.col("_m") + F.log("_z")).drop("_z")


def softmax(pred: DataFrame, item: str = "item_id", logit: str = "logit") -> DataFrame:
    """M2: probability of each choice within its item."""
    m = pred.groupBy(item).agg(F.max(logit).alias("_m"))
    e = pred.join(m, item).withColumn("_e", F.exp(F.col(logit) - F.col("_m")))
    z = e.groupBy(item).agg(F.sum("_e").alias("_z"))
    return e.join(z, item).withColumn("prob", F.col("_e") / F.col("_z")).drop("_m", "_e", "_z")


def cross_entropy(pred: DataFrame, item: str = "item_id", logit: str = "logit",
                  label: str = "label", by: list[str] | None = None) -> DataFrame:
    """M5: mean over items of ``lse - logit[gold]``."""
    t = log_softmax_terms(pred, item, logit)
    per_item = t.where(F.col(label) == 1).select(*(by or []), item,
                                                  (F.col("lse") - F.col(logit)).alias("ce"))
    return per_item.groupBy(*(by or [])).agg(F.avg("ce").alias("cross_entropy"),
                                             F.count(F.lit(1)).alias("n_items"))


def argmax_choice(pred: DataFrame, item: str = "item_id", choice: str = "choice_idx",
                  score: str = "logit", keep: list[str] | None = None) -> DataFrame:
    """A3: predicted choice per item (highest score, lowest choice on ties),
    and the gold choice (the one labelled 1, if any)."""
    pick = F.max_by(F.struct(F.col(choice).alias("c"), F.col(score).alias("s")),
                    F.struct(F.col(score), -F.col(choice)))
    gold = F.max_by(F.col(choice), F.struct(F.col("label"), -F.col(choice)))
    aggs = [pick.alias("_p"), gold.alias("gold_choice"), F.max("label").alias("_has_gold")]
    # ``keep`` columns are functions of the item (e.g. its split)
    out = pred.groupBy(item, *(keep or [])).agg(*aggs)
    return out.select(item, *(keep or []), F.col("_p.c").alias("pred_choice"),
                      F.col("_p.s").alias("pred_score"),
                      F.when(F.col("_has_gold") == 1, F.col("gold_choice")).alias("gold_choice"))


def item_accuracy(pred: DataFrame, by: list[str] | None = None, item: str = "item_id",
                  score: str = "logit") -> DataFrame:
    """A4/A5: an item is right when its argmax choice is the gold choice;
    accuracy = right items / all items (grouped by ``by``)."""
    a = argmax_choice(pred, item, score=score, keep=by)
    right = (F.col("pred_choice") == F.col("gold_choice")).cast("int")
    return a.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.coalesce(F.sum(right), F.lit(0)).cast("bigint").alias("n_correct")) \
        .withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_items"), 9))


def weighted_epoch_loss(steps: DataFrame, by: list[str], loss: str = "val_loss",
                        weight: str = "n") -> DataFrame:
    """Batch-size-weighted mean of step losses."""
    return steps.groupBy(*by).agg(
        (F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("loss"),
        F.count(F.lit(1)).alias("n_steps"))


def training_budget(items: DataFrame, by: str = "split", batch_size: int = 4,
                    accumulation: int = 4, epochs: int = 10,
                    warmup_proportion: float = 0.1) -> DataFrame:
    """A10: optimiser steps ``int(n / batch / accum * epochs)`` and warm-up
    ``int(total * p)`` per split."""
    total = F.floor(F.col("n_items") / batch_size / accumulation * epochs).cast("bigint")
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("n_items")) \
        .withColumn("total_steps", total) \
        .withColumn("warmup_steps",
                    F.floor(F.col("total_steps") * warmup_proportion).cast("bigint"))


def best_checkpoint(metrics: DataFrame, run: str = "run_id", ckpt: str = "checkpoint",
                    epoch: str = "epoch") -> DataFrame:
    """Best checkpoint per run, mode given per metric (min loss, max
    accuracy; earliest epoch on ties)."""
    by_loss = F.min_by(F.struct(F.col(ckpt).alias("c"), F.col("val_loss").alias("v")),
                       F.struct(F.col("val_loss"), F.col(epoch)))
    by_acc = F.max_by(F.struct(F.col(ckpt).alias("c"), F.col("val_accuracy").alias("v")),
                      F.struct(F.col("val_accuracy"), -F.col(epoch)))
    return metrics.groupBy(run).agg(by_loss.alias("_l"), by_acc.alias("_a")).select(
        run, F.col("_l.c").alias("best_loss_checkpoint"), F.col("_l.v").alias("best_loss"),
        F.col("_a.c").alias("best_accuracy_checkpoint"),
        F.col("_a.v").alias("best_accuracy"))


EPOCHS = 4096      # epochs of a block


def blocked_prefix(df: DataFrame, run: str, order: str, value: Column, fn, out: str,
                   inclusive: bool = False, block: int = EPOCHS) -> DataFrame:
    """``out``: ``fn`` (``F.min`` or ``F.max``) of ``value`` over the run's rows of
    lower ``order`` (and the row itself if ``inclusive``); null when there is
    none.  Blocks of ``order`` values are aggregated first, a window carries
    over the blocks of a run, and the windows inside a block hold at most
    ``block`` orders, so a run of any length is spread over tasks."""
    b = F.floor(F.col(order) / block)
    rows = df.withColumn("_block", b).withColumn("_value", value)
    blocks = rows.groupBy(run, "_block").agg(fn("_value").alias("_agg"))
    before = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(run, "_block", fn("_agg").over(before).alias("_carry"))
    inside = Window.partitionBy(run, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    pick = F.least if fn is F.min else F.greatest      # both skip nulls
    return rows.join(carry, [run, "_block"]).withColumn(out, pick("_carry", fn("_value").over(inside))) \
        .drop("_block", "_value", "_carry")


def early_stop_epoch(metrics: DataFrame, patience: int = 3, run: str = "run_id",
                     epoch: str = "epoch", monitor: str = "val_loss",
                     mode: str = "min", block: int = EPOCHS) -> DataFrame:
    """The first epoch after ``patience`` epochs without improvement of
    ``monitor`` (null when training would run to the end).  Best value so far
    and last improvement are prefixes over blocks of epochs."""
    fn = F.min if mode == "min" else F.max
    m = blocked_prefix(metrics.select(run, epoch, monitor), run, epoch, F.col(monitor), fn, "_best", False, block)
    better = (F.col(monitor) < F.col("_best")) if mode == "min" else (F.col(monitor) > F.col("_best"))
    improved = F.col("_best").isNull() | better
    m = blocked_prefix(m, run, epoch, F.when(improved, F.col(epoch)), F.max, "_last", True, block)
    return m.groupBy(run).agg(
        F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.max(epoch).alias("last_epoch"))


def evaluate(pred: DataFrame, by: str = "split", item: str = "item_id",
             choice: str = "choice_idx", logit: str = "logit",
             label: str = "label") -> DataFrame:
    """L3 in two passes over the prediction rows: per-item max (joined back),
    then one per-item aggregate holding the softmax normaliser, argmax, gold
    choice and logit and the BCE partial sums; the per-split report
    aggregates the (much smaller) per-item rows.  Gives the same numbers as
    ``item_accuracy`` + ``cross_entropy`` + mean BCE by ``by``."""
    m = pred.groupBy(item).agg(F.max(logit).alias("_m"))
    j = pred.join(m, item)
    gold_order = F.struct(F.col(label), -F.col(choice))
    per_item = j.groupBy(item, by).agg(
        F.max("_m").alias("_m"),
        F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_z"),
        F.max_by(F.col(choice), F.struct(F.col(logit), -F.col(choice))).alias("_pred"),
        F.max_by(F.col(choice), gold_order).alias("_gold"),
        F.max_by(F.col(logit), gold_order).alias("_gold_logit"),
        F.max(label).alias("_has_gold"),
        F.sum(bce_with_logits(logit, F.col(label).cast("double"))).alias("_bce"),
        F.count(F.lit(1)).alias("_n"))
    has_gold = F.col("_has_gold") == 1
    right = (has_gold & (F.col("_pred") == F.col("_gold"))).cast("int")
    ce = F.when(has_gold, F.col("_m") + F.log("_z") - F.col("_gold_logit"))
    return per_item.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(right).cast("bigint").alias("n_correct"),
        F.avg(ce).alias("_ce"),
        (F.sum("_bce") / F.sum("_n")).alias("_bce")) \
        .select(by, "n_items", "n_correct",
                F.round(F.col("n_correct") / F.col("n_items"), 9).alias("accuracy"),
                F.round("_ce", 9).alias("cross_entropy"), F.round("_bce", 9).alias("bce"))
