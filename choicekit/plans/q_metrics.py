"""Registered queries: softmax, sigmoid, losses, argmax, accuracies, epoch
loss, training budget, best checkpoint, early stop (M2–M5, A3–A11, T6)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .fixtures import mc_items, predictions, run_metrics, with_ctes
from .registry import register

PATIENCE = 3


@register("choice_softmax", with_ctes("predictions") + """
SELECT item_id, choice_idx, round(exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY item_id),
                                  9) AS prob
FROM (SELECT *, max(logit) OVER (PARTITION BY item_id) AS m FROM predictions)""")
def q_choice_softmax(spark, sf):
    s = M.softmax(predictions(spark, sf))
    return s.select("item_id", "choice_idx", F.round("prob", 9).alias("prob"))


@register("choice_sigmoid", with_ctes("predictions") + """
SELECT item_id, choice_idx, round(1 / (1 + exp(-logit)), 9) AS prob FROM predictions""")
def q_choice_sigmoid(spark, sf):
    p = predictions(spark, sf)
    return p.select("item_id", "choice_idx", F.round(M.sigmoid("logit"), 9).alias("prob"))


@register("bce_loss", with_ctes("predictions") + """
SELECT split, round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 9) AS bce,
       count(*) AS n_rows
FROM predictions GROUP BY split""")
def q_bce_loss(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy("split").agg(
        F.round(F.avg(M.bce_with_logits("logit", F.col("label").cast("double"))), 9).alias("bce"),
        F.count(F.lit(1)).alias("n_rows"))


@register("choice_cross_entropy", with_ctes("predictions") + """
SELECT split, round(avg(lse - logit), 9) AS cross_entropy, count(*) AS n_items
FROM (SELECT p.split, p.logit, p.label, a.m + ln(a.z) AS lse
      FROM predictions p JOIN (
        SELECT item_id, max(m) AS m, sum(exp(logit - m)) AS z
        FROM (SELECT *, max(logit) OVER (PARTITION BY item_id) AS m FROM predictions)
        GROUP BY item_id) a ON p.item_id = a.item_id)
WHERE label = 1 GROUP BY split""")
def q_choice_cross_entropy(spark, sf):
    ce = M.cross_entropy(predictions(spark, sf), by=["split"])
    return ce.select("split", F.round("cross_entropy", 9).alias("cross_entropy"), "n_items")


_ARGMAX = """
am AS (SELECT item_id, split, choice_idx AS pred_choice, logit AS pred_score FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY logit DESC, choice_idx) AS r
         FROM predictions) WHERE r = 1),
gold AS (SELECT item_id, min(choice_idx) AS gold_choice FROM predictions WHERE label = 1
         GROUP BY item_id),
scored AS (SELECT am.*, gold.gold_choice FROM am LEFT JOIN gold ON am.item_id = gold.item_id)
"""


def _argmax_with():
    return with_ctes("predictions").rstrip("\n") + ",\n" + _ARGMAX


@register("argmax_choice", _argmax_with() +
          "SELECT item_id, pred_choice, pred_score, gold_choice FROM scored")
def q_argmax_choice(spark, sf):
    return M.argmax_choice(predictions(spark, sf))


@register("item_accuracy_flat", with_ctes("predictions") + """,
pr AS (SELECT *, round(1 / (1 + exp(-logit)), 9) AS prob FROM predictions),
am AS (SELECT item_id, choice_idx AS pred_choice FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY prob DESC, choice_idx) AS r
         FROM pr) WHERE r = 1),
gold AS (SELECT item_id, min(choice_idx) AS gold_choice FROM predictions WHERE label = 1
         GROUP BY item_id)
SELECT count(*) AS n_items,
       CAST(coalesce(sum(CAST(pred_choice = gold_choice AS INTEGER)), 0) AS BIGINT) AS n_correct,
       round(CAST(coalesce(sum(CAST(pred_choice = gold_choice AS INTEGER)), 0) AS BIGINT)
             / count(*), 9) AS accuracy
FROM am LEFT JOIN gold ON am.item_id = gold.item_id""")
def q_item_accuracy_flat(spark, sf):
    """A4: per question, argmax of sigmoid probabilities vs argmax of labels."""
    p = predictions(spark, sf).withColumn("prob", F.round(M.sigmoid("logit"), 9))
    return M.item_accuracy(p, score="prob")


@register("item_accuracy_class", _argmax_with() + """
SELECT split, count(*) AS n_items,
       CAST(coalesce(sum(CAST(pred_choice = gold_choice AS INTEGER)), 0) AS BIGINT) AS n_correct,
       round(CAST(coalesce(sum(CAST(pred_choice = gold_choice AS INTEGER)), 0) AS BIGINT)
             / count(*), 9) AS accuracy
FROM scored GROUP BY split""")
def q_item_accuracy_class(spark, sf):
    return M.item_accuracy(predictions(spark, sf), by=["split"])


@register("mean_equality_accuracy", _argmax_with() + """
SELECT round(avg(CASE WHEN pred_choice = gold_choice THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM scored""")
def q_mean_equality_accuracy(spark, sf):
    a = M.argmax_choice(predictions(spark, sf))
    eq = F.when(F.col("pred_choice") == F.col("gold_choice"), 1.0).otherwise(0.0)
    return a.agg(F.round(F.avg(eq), 9).alias("accuracy"))


@register("epoch_loss", with_ctes("run_metrics") + """
SELECT epoch, round(sum(val_loss * n) / sum(n), 9) AS loss, count(*) AS n_steps
FROM run_metrics GROUP BY epoch""")
def q_epoch_loss(spark, sf):
    e = M.weighted_epoch_loss(run_metrics(spark, sf), ["epoch"])
    return e.select("epoch", F.round("loss", 9).alias("loss"), "n_steps")


@register("training_budget", with_ctes("mc_items") + """
SELECT split, n_items, total_steps, CAST(floor(total_steps * 0.1) AS BIGINT) AS warmup_steps
FROM (SELECT split, count(*) AS n_items,
             CAST(floor(count(*) / 4 / 4 * 10) AS BIGINT) AS total_steps
      FROM mc_items GROUP BY split)""")
def q_training_budget(spark, sf):
    return M.training_budget(mc_items(spark, sf))


@register("best_checkpoint", with_ctes("run_metrics") + """
SELECT run_id,
       arg_min(checkpoint, (val_loss, epoch)) AS best_loss_checkpoint, min(val_loss) AS best_loss,
       arg_max(checkpoint, (val_accuracy, -epoch)) AS best_accuracy_checkpoint,
       max(val_accuracy) AS best_accuracy
FROM run_metrics GROUP BY run_id""")
def q_best_checkpoint(spark, sf):
    return M.best_checkpoint(run_metrics(spark, sf))


@register("early_stop_epoch", with_ctes("run_metrics") + f""",
m AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM run_metrics),
i AS (SELECT *, (bb IS NULL OR val_loss < bb) AS imp FROM m),
l AS (SELECT *, max(CASE WHEN imp THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM i)
SELECT run_id, min(CASE WHEN epoch - last_imp >= {PATIENCE} THEN epoch END) AS stop_epoch,
       max(epoch) AS last_epoch
FROM l GROUP BY run_id""")
def q_early_stop_epoch(spark, sf):
    return M.early_stop_epoch(run_metrics(spark, sf), patience=PATIENCE)
