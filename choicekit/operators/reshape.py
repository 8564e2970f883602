"""Reshape, union and projection operators.

All reshapes here are narrow (``posexplode``/``transform`` per row): no
shuffle.  The only grouped step, ``regroup_choices``, groups by item id, whose
size is bounded by the item's own option list.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Answer letter -> option index; any other letter maps to -1,
# so no option of that item is marked correct.
ANSWER_LETTERS = {"A": 0, "B": 1, "C": 2, "D": 3}


def letter_index(letter) -> Column:
    m = F.create_map(*[x for k, v in ANSWER_LETTERS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[tx.col(letter)], F.lit(-1))


def binarise(df: DataFrame, options: str, correct_index: Column | str,
             question: str = "question", context: str = "context",
             keys: tuple[str, ...] = ("example_id", "split")) -> DataFrame:
    """One row per option with ``correct = (position == correct_index)``.

    Output: ``keys…, choice_idx, question, answer, context, correct``.
    """
    ci = tx.col(correct_index)
    exploded = df.select(*keys, F.col(question).alias("_q"), F.col(context).alias("_c"),
                         ci.alias("_ci"), F.posexplode(options).alias("_pos", "_ans"))
    return exploded.select(
        *keys,
        F.col("_pos").cast("bigint").alias("choice_idx"),
        F.col("_q").alias("question"),
        F.col("_ans").alias("answer"),
        F.col("_c").alias("context"),
        (F.col("_pos") == F.col("_ci")).cast("int").alias("correct"))


def binarise_by_index(df, options="answers", correct_id="correct_answer_id",
                      question="question", context="context", keys=("example_id", "split")):
    """Index form (correct option given as a position)."""
    return binarise(df, options, correct_id, question, context, keys)


def binarise_by_letter(df, options="options", letter="answer", question="question",
                       context="article", keys=("example_id", "split")):
    """Letter form (A–D; other letters give no correct option)."""
    return binarise(df, options, letter_index(letter), question, context, keys)


def choice_pairs(df: DataFrame, options="options", question="question", context="article",
                 key="example_id") -> DataFrame:
    """Per option, (context, question + ' ' + option)."""
    return df.select(key, F.col(context).alias("first"), F.col(question).alias("_q"),
                     F.posexplode(options).alias("_pos", "_opt")) \
        .select(key, F.col("_pos").cast("bigint").alias("choice_idx"), "first",
                F.concat_ws(" ", "_q", "_opt").alias("second"))


def two_choice_pairs(df: DataFrame, premise="premise", question="question",
                     choice1="choice1", choice2="choice2", key="example_id") -> DataFrame:
    """(premise + ' ' + question) x [choice1, choice2]."""
    return df.select(key, F.concat_ws(" ", premise, question).alias("first"),
                     F.posexplode(F.array(choice1, choice2)).alias("_pos", "second")) \
        .select(key, F.col("_pos").cast("bigint").alias("choice_idx"), "first", "second")


def regroup_choices(flat: DataFrame, key="example_id", idx="choice_idx",
                    value="answer") -> DataFrame:
    """Flat choices back to one row per item, ordered by choice index."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"),
                                                   F.col(value).alias("v"))))
    return flat.groupBy(key).agg(ordered.alias("_s")) \
        .select(key, F.col("_s.v").alias(f"{value}s"), F.size("_s").alias("n_choices"))


def unnest_choices(df: DataFrame, flat="flat_ids", n_choices="n_choices",
                   length: int = 8, key="example_id") -> DataFrame:
    """A flat (C*L) array viewed as C rows of length L."""
    idx = F.sequence(F.lit(0), F.col(n_choices) - 1)
    return df.select(key, flat, F.explode(idx).alias("choice_idx")) \
        .select(key, F.col("choice_idx").cast("bigint").alias("choice_idx"),
                F.slice(flat, F.col("choice_idx") * length + 1, F.lit(length)).alias("ids"))


def flatten_options(df: DataFrame, options="options", key="example_id") -> DataFrame:
    """List of lists (words of each option) flattened to one list."""
    words = F.flatten(F.transform(options, lambda o: tx.word_tokens(o)))
    return df.select(key, words.alias("words"))


def union_by_name(frames: dict[str, DataFrame]) -> DataFrame:
    """Concatenate frames whose columns differ; missing columns are null.
    Each row keeps its ``source`` name."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_splits(df: DataFrame, splits=("train", "validation"), split="split") -> DataFrame:
    """Train + validation as one frame (a pushed-down predicate)."""
    return df.where(F.col(split).isin(list(splits)))


def tag_column(flag: Column, when_true: str, otherwise: Column | str) -> Column:
    """constant/conditional tag."""
    other = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    return F.when(flag, F.lit(when_true)).otherwise(other)
