"""Registered queries: linear scorer, settings grid, split report, item-level choice
scorer (C4–C6).  Training is iterative, so fitted queries have no SQL oracle; scoring
with given weights has one."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import choice_scorer as CS
from ..operators import metrics as M
from ..operators import scorer as SC
from ..sources.files import stage
from ..sources.tables import table
from . import sqltext as S
from .fixtures import mc_items, split_of, with_ctes
from .registry import register


def scoring_table(spark, sf):
    """Embedding rows with a binary target (class 0 against the rest) and a
    split by vec_id."""
    e = table(spark, sf, "embeddings")
    return SC.features(e).withColumn("y", (F.col("label") == 0).cast("double")) \
        .withColumn("split", split_of("vec_id"))


@register("linear_scorer")
def q_linear_scorer(spark, sf):
    t = scoring_table(spark, sf)
    model = SC.fit_linear(t.where(F.col("split") == "train"))
    s = SC.score(model, t)
    return s.select("vec_id", "split", "y", "prediction", F.round("prob", 6).alias("prob"))


@register("scorer_grid")
def q_scorer_grid(spark, sf):
    t = scoring_table(spark, sf)
    return SC.grid_search(t.where(F.col("split") == "train"))


@register("score_and_report")
def q_score_and_report(spark, sf):
    t = scoring_table(spark, sf)
    model = SC.fit_linear(t.where(F.col("split") == "train"))
    return SC.split_report(SC.score(model, t))


# weights of the report query: length, words, share of words in the question, place
GIVEN = (0.3, -0.2, 1.5, -0.4)


def choice_features(spark, sf):
    """A row per option of every item with four features of the option: its length, its
    words, the share of its distinct words that the question holds, and its place."""
    flat = mc_items(spark, sf).select("example_id", "split", "question", "correct_answer_id",
                                      F.posexplode("options").alias("choice_idx", "option"))
    words = flat.withColumn("q", tx.word_tokens(F.lower("question"))).withColumn("o", tx.word_tokens(F.lower("option")))
    n = F.size(F.array_distinct("o"))
    shared = F.when(n > 0, F.size(F.array_intersect("o", "q")) / n).otherwise(F.lit(0.0))
    return words.select(
        F.col("example_id").alias("item_id"), "split", F.col("choice_idx").cast("bigint").alias("choice_idx"),
        F.array(F.length("option") / 100.0, F.size("o") / 10.0, shared, F.col("choice_idx") / 4.0).alias("x"),
        F.when(F.col("choice_idx") == F.col("correct_answer_id"), 1).otherwise(0).alias("label"))


@register("choice_scorer")
def q_choice_scorer(spark, sf):
    """Conditional logit fitted on the train split, then every item scored and each split
    reported (no oracle: fitted; tests hold it against a plain Newton iteration)."""
    c = stage(choice_features(spark, sf), "choice-features")
    model = CS.fit_choice_scorer(c.where(F.col("split") == "train"), "item_id")
    return M.evaluate(CS.score_choices(c, model.weights))


_TERMS = " + ".join(f"x{i} * ({w})" for i, w in enumerate(GIVEN))


@register("choice_score_report", with_ctes("mc_items") + f""",
flat AS (SELECT example_id, split, question, correct_answer_id, unnest(options) AS option,
                unnest(range(len(options))) AS choice_idx FROM mc_items),
words AS (SELECT *, {S.tokens('lower(question)')} AS q, {S.tokens('lower(option)')} AS o FROM flat),
x AS (SELECT *, length(option) / 100.0 AS x0, len(o) / 10.0 AS x1, choice_idx / 4.0 AS x3,
             CASE WHEN len(list_distinct(o)) > 0
                  THEN len(list_intersect(list_distinct(o), q)) / len(list_distinct(o)) ELSE 0.0 END AS x2 FROM words),
predictions AS (SELECT example_id AS item_id, split, choice_idx, CAST({_TERMS} AS DOUBLE) AS logit,
                       CASE WHEN choice_idx = correct_answer_id THEN 1 ELSE 0 END AS label FROM x),""" + S.EVALUATE)
def q_choice_score_report(spark, sf):
    """The report of saved scores: options scored with given weights, written as a stage,
    then accuracy by item, cross-entropy and BCE of each split."""
    return M.evaluate(stage(CS.score_choices(choice_features(spark, sf), GIVEN), "choice-scores"))
