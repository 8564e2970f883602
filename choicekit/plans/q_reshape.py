"""Registered queries: reshape, joins, unions, projections (E, J1/J2, U, P, S10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import joins as J
from ..operators import reshape as R
from ..sources.tables import table
from .fixtures import length_ids, mc_item_rejects, mc_items, with_ctes, words_of
from .registry import register

# ---------------------------------------------------------------- helpers (SQL)
UNNEST_OPTIONS = ("(SELECT *, unnest(options) AS opt, unnest(range(len(options))) AS pos "
                  "FROM mc_items)")
LETTER_SQL = ("CASE answer WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 "
              "WHEN 'D' THEN 3 ELSE -1 END")


def translated_items(spark, sf, delimiter: str):
    """Wide items as the translation step leaves them: translated columns and
    the translated options as one delimited string."""
    m = mc_items(spark, sf)
    return m.select("example_id", "split", "correct_answer_id", "answer",
                    F.col("question").alias("translated_question"),
                    F.col("article").alias("translated_context"),
                    tx.join_list(tx.replace_in_items("options", delimiter, " "), delimiter)
                    .alias("translated_answers"))


def translated_sql(delimiter: str) -> str:
    return (f"(SELECT example_id, split, correct_answer_id, answer, "
            f"question AS translated_question, article AS translated_context, "
            f"array_to_string(list_transform(options, lambda x: replace(x, '{delimiter}', ' ')),"
            f" '{delimiter}') AS translated_answers FROM mc_items)")


@register("mc_item_rejects", with_ctes("mc_sentences") + """
SELECT doc_id, CAST(len(s) % 5 AS BIGINT) AS n_left,
       array_to_string(s[len(s) - len(s) % 5 + 1 : len(s)], ' ') AS left_over
FROM (SELECT doc_id, coalesce(snt, []::VARCHAR[]) AS s FROM mc_sentences)
WHERE len(s) % 5 > 0 OR len(s) = 0""")
def q_mc_item_rejects(spark, sf):
    return mc_item_rejects(spark, sf)


# ---------------------------------------------------------------- E1-E4
@register("binarise_by_index", with_ctes("mc_items") + f"""
SELECT example_id, split, CAST(pos AS BIGINT) AS choice_idx, question, opt AS answer,
       article AS context, CAST(CASE WHEN pos = correct_answer_id THEN 1 ELSE 0 END AS INTEGER)
         AS correct
FROM {UNNEST_OPTIONS}""")
def q_binarise_by_index(spark, sf):
    return R.binarise_by_index(mc_items(spark, sf), options="options", context="article")


@register("binarise_by_letter", with_ctes("mc_items") + f"""
SELECT example_id, split, CAST(pos AS BIGINT) AS choice_idx, question, opt AS answer,
       article AS context, CAST(CASE WHEN pos = {LETTER_SQL} THEN 1 ELSE 0 END AS INTEGER)
         AS correct
FROM {UNNEST_OPTIONS}""")
def q_binarise_by_letter(spark, sf):
    return R.binarise_by_letter(mc_items(spark, sf))


def _translated_sql(delimiter: str, correct: str) -> str:
    return with_ctes("mc_items") + f"""
SELECT example_id, split, CAST(pos AS BIGINT) AS choice_idx, translated_question AS question,
       opt AS answer, translated_context AS context,
       CAST(CASE WHEN pos = {correct} THEN 1 ELSE 0 END AS INTEGER) AS correct
FROM (SELECT *, unnest(parts) AS opt, unnest(range(len(parts))) AS pos
      FROM (SELECT *, string_split(translated_answers, '{delimiter}') AS parts
            FROM {translated_sql(delimiter)}))"""


@register("binarise_translated_index", _translated_sql("|", "correct_answer_id"))
def q_binarise_translated_index(spark, sf):
    t = translated_items(spark, sf, "|") \
        .withColumn("translated_answers", tx.split_literal("translated_answers", "|"))
    return R.binarise_by_index(t, options="translated_answers", question="translated_question",
                               context="translated_context")


@register("binarise_translated_letter", _translated_sql(",", LETTER_SQL))
def q_binarise_translated_letter(spark, sf):
    t = translated_items(spark, sf, ",") \
        .withColumn("translated_answers", tx.split_literal("translated_answers", ","))
    return R.binarise_by_letter(t, options="translated_answers", question="translated_question",
                                context="translated_context")


# ---------------------------------------------------------------- E5-E10
@register("choice_pairs", with_ctes("mc_items") + f"""
SELECT example_id, CAST(pos AS BIGINT) AS choice_idx, article AS first,
       concat_ws(' ', question, opt) AS second
FROM {UNNEST_OPTIONS}""")
def q_choice_pairs(spark, sf):
    return R.choice_pairs(mc_items(spark, sf))


def two_choice_items(spark, sf):
    """Two-choice items: premise, cause/effect question, two choices, label."""
    m = mc_items(spark, sf)
    # the four options of an item make two two-choice items
    two = F.array(F.slice("options", 1, 2), F.slice("options", 3, 2))
    p = m.select("example_id", "question", "correct_answer_id", F.posexplode(two).alias("p", "o"))
    return p.select((F.col("example_id") * 2 + F.col("p")).alias("example_id"),
                    F.col("question").alias("premise"),
                    F.when(F.col("p") == 0, "cause").otherwise("effect").alias("question"),
                    F.col("o")[0].alias("choice1"), F.col("o")[1].alias("choice2"),
                    (F.col("correct_answer_id") % 2).alias("label"))


@register("two_choice_pairs", with_ctes("mc_items") + """
SELECT example_id, CAST(pos AS BIGINT) AS choice_idx,
       concat_ws(' ', question, CASE WHEN p = 0 THEN 'cause' ELSE 'effect' END) AS first,
       second
FROM (SELECT example_id * 2 + p AS example_id, question, p,
             unnest([options[2 * p + 1], options[2 * p + 2]]) AS second, unnest(range(2)) AS pos
      FROM (SELECT *, unnest(range(2)) AS p FROM mc_items))""")
def q_two_choice_pairs(spark, sf):
    return R.two_choice_pairs(two_choice_items(spark, sf))


@register("regroup_choices", with_ctes("mc_items") + f"""
SELECT example_id, array_to_string(list(opt ORDER BY pos), '|') AS answers,
       count(*) AS n_choices
FROM {UNNEST_OPTIONS}
GROUP BY example_id""")
def q_regroup_choices(spark, sf):
    flat = R.binarise_by_letter(mc_items(spark, sf))
    g = R.regroup_choices(flat)
    return g.select("example_id", F.array_join("answers", "|").alias("answers"),
                    F.col("n_choices").cast("bigint").alias("n_choices"))


CHOICE_LEN = 60    # per-choice length of the reference's two-choice encoder


def padded_word_lengths(c, length: int = CHOICE_LEN):
    lens = length_ids(words_of(c) if isinstance(c, str) else c)
    return F.slice(F.concat(F.slice(lens, 1, length), F.array_repeat(F.lit(0), length)),
                   1, length)


@register("unnest_choices", with_ctes("mc_items") + f"""
SELECT example_id, CAST(i AS BIGINT) AS choice_idx,
       array_to_string(flat[i * {CHOICE_LEN} + 1 : i * {CHOICE_LEN} + {CHOICE_LEN}], ' ') AS ids
FROM (SELECT example_id, n, flat, unnest(range(n)) AS i
      FROM (SELECT example_id, len(options) AS n,
                   flatten(list_transform(options, lambda o: list_resize(
                     list_transform(list_filter(regexp_split_to_array(o, '[ \\t\\n\\r]+'),
                                                lambda w: w <> ''),
                                    lambda w: CAST(length(w) + 102 AS INTEGER))[1:{CHOICE_LEN}],
                     {CHOICE_LEN}, 0))) AS flat
            FROM mc_items))""")
def q_unnest_choices(spark, sf):
    m = mc_items(spark, sf)
    flat = m.select("example_id", F.size("options").alias("n_choices"),
                    F.flatten(F.transform("options", lambda o: padded_word_lengths(
                        F.filter(F.split(o, r"[ \t\n\r]+", -1), lambda w: w != ""))))
                    .alias("flat_ids"))
    u = R.unnest_choices(flat, length=CHOICE_LEN)
    return u.select("example_id", "choice_idx", F.array_join("ids", " ").alias("ids"))


@register("flatten_options", with_ctes("mc_items") + """
SELECT example_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT example_id, flatten(list_transform(options,
        lambda o: regexp_extract_all(o, '[\\p{L}\\p{N}_]{2,}'))) AS w FROM mc_items)""")
def q_flatten_options(spark, sf):
    f = R.flatten_options(mc_items(spark, sf))
    return f.select("example_id", F.size("words").cast("bigint").alias("n_words"),
                    F.array_join("words", " ").alias("words"))


# ---------------------------------------------------------------- U1-U3, S10
def flat_rows(spark, sf):
    return flat_rows_of(mc_items(spark, sf))


def flat_rows_of(m):
    """Flat rows in the third dataset's form (question, answer, context, correct)
    with its extra columns dropped in every split (B3)."""
    return m.select("split", "question", F.explode("options").alias("answer"),
                    F.col("article").alias("context"), F.lit(1).alias("correct"),
                    F.col("article").alias("text"), F.lit("given").alias("reason")) \
        .drop("text", "reason")


@register("union_missing_columns", with_ctes("mc_items") + f"""
SELECT * FROM (
  SELECT 'indexed' AS source, example_id, split, CAST(pos AS BIGINT) AS choice_idx, question,
         opt AS answer, article AS context,
         CAST(CASE WHEN pos = correct_answer_id THEN 1 ELSE 0 END AS INTEGER) AS correct
  FROM {UNNEST_OPTIONS}
  UNION ALL BY NAME
  SELECT 'lettered' AS source, example_id, split, CAST(pos AS BIGINT) AS choice_idx, question,
         opt AS answer, article AS context,
         CAST(CASE WHEN pos = {LETTER_SQL} THEN 1 ELSE 0 END AS INTEGER) AS correct
  FROM {UNNEST_OPTIONS}
  UNION ALL BY NAME
  SELECT 'flat' AS source, split, question, unnest(options) AS answer, article AS context,
         1 AS correct
  FROM mc_items)""")
def q_union_missing_columns(spark, sf):
    m = mc_items(spark, sf)
    return R.union_by_name({
        "indexed": R.binarise_by_index(m, options="options", context="article"),
        "lettered": R.binarise_by_letter(m),
        "flat": flat_rows(spark, sf),
    })


@register("union_train_val", with_ctes("mc_items") + f"""
SELECT example_id, split, CAST(pos AS BIGINT) AS choice_idx, question, opt AS answer,
       article AS context, CAST(CASE WHEN pos = correct_answer_id THEN 1 ELSE 0 END AS INTEGER)
         AS correct
FROM {UNNEST_OPTIONS} WHERE split IN ('train', 'validation')""")
def q_union_train_val(spark, sf):
    flat = R.binarise_by_index(mc_items(spark, sf), options="options", context="article")
    return R.keep_splits(flat)


@register("split_counts", with_ctes("mc_items") + f"""
SELECT split, count(*) AS n_rows,
       CAST(sum(CASE WHEN pos = {LETTER_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       count(DISTINCT example_id) AS n_items
FROM {UNNEST_OPTIONS} GROUP BY split""")
def q_split_counts(spark, sf):
    flat = R.binarise_by_letter(mc_items(spark, sf))
    return flat.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum("correct").cast("bigint").alias("n_correct"),
                                     F.countDistinct("example_id").alias("n_items"))


@register("select_rename_drop", """
SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total_price,
       c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_select_rename_drop(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"),
                                          F.col("o_custkey").alias("customer_id"),
                                          F.col("o_orderstatus").alias("status"),
                                          F.col("o_totalprice").alias("total_price"))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment") \
        .withColumnRenamed("c_mktsegment", "segment")
    return o.join(c, o.customer_id == c.c_custkey).drop("customer_id", "c_custkey")


# ---------------------------------------------------------------- J1, J2, U3
def _parts(spark, sf):
    m = mc_items(spark, sf)
    questions = m.select(F.col("example_id").alias("row_id"), "example_id", "question")
    answers = m.select(F.col("example_id").alias("row_id"),
                       tx.join_list("options", ",").alias("translated_answers"))
    contexts = m.select((F.col("example_id") % 50).alias("key"),
                        F.col("example_id").alias("row_id"),
                        F.col("article").alias("translated_context"))
    return m, questions, answers, contexts


@register("join_by_row_id", with_ctes("mc_items") + """
SELECT example_id AS row_id, example_id, question,
       array_to_string(options, ',') AS translated_answers
FROM mc_items""")
def q_join_by_row_id(spark, sf):
    _, q, a, _ = _parts(spark, sf)
    return J.join_by_row_id(q, a)


@register("join_fanout", with_ctes("mc_items") + """
SELECT l.key, left_rows, right_rows, left_rows * right_rows AS joined_rows
FROM (SELECT example_id % 50 AS key, count(*) AS left_rows FROM mc_items GROUP BY 1) l
JOIN (SELECT example_id % 50 AS key, count(*) AS right_rows FROM mc_items GROUP BY 1) r
  ON l.key = r.key""")
def q_join_fanout(spark, sf):
    m, _, _, contexts = _parts(spark, sf)
    left = m.select((F.col("example_id") % 50).alias("key"), "example_id")
    return J.fanout_profile(left, contexts, "key")


@register("join_deduped", with_ctes("mc_items") + """
SELECT l.key, l.example_id, r.row_id AS context_row_id, length(r.ctx) AS context_chars
FROM (SELECT example_id % 50 AS key, example_id FROM mc_items) l
JOIN (SELECT example_id % 50 AS key, min(example_id) AS row_id,
             arg_min(article, example_id) AS ctx FROM mc_items GROUP BY 1) r
  ON l.key = r.key""")
def q_join_deduped(spark, sf):
    m, _, _, contexts = _parts(spark, sf)
    left = m.select((F.col("example_id") % 50).alias("key"), "example_id")
    j = J.join_deduped(left, contexts, "key", "row_id")
    return j.select("key", "example_id", F.col("row_id").alias("context_row_id"),
                    F.length("translated_context").cast("bigint").alias("context_chars"))


@register("dedup_keep_first", with_ctes("mc_items") + """
SELECT example_id % 50 AS key, min(example_id) AS row_id,
       length(arg_min(article, example_id)) AS context_chars
FROM mc_items GROUP BY 1""")
def q_dedup_keep_first(spark, sf):
    _, _, _, contexts = _parts(spark, sf)
    d = J.dedup_keep_first(contexts, "key", "row_id")
    return d.select("key", "row_id", F.length("translated_context").cast("bigint").alias("context_chars"))


# ---------------------------------------------------------------- streaming
@register("stream_binarise", with_ctes("mc_items") + f"""
SELECT example_id, split, CAST(pos AS BIGINT) AS choice_idx, question, opt AS answer,
       article AS context, CAST(CASE WHEN pos = {LETTER_SQL} THEN 1 ELSE 0 END AS INTEGER)
         AS correct
FROM {UNNEST_OPTIONS}""")
def q_stream_binarise(spark, sf):
    """The build steps as a Structured Streaming query over the documents
    files (available-now trigger), read back from its exactly-once sink."""
    from ..session import shared_dir
    from ..streaming.incremental import start_file_stream
    from .fixtures import mc_items_from

    out = shared_dir(spark, "stream")
    q = start_file_stream(spark, sf, "documents.parquet",
                          lambda docs: R.binarise_by_letter(mc_items_from(docs)),
                          f"{out}/data", f"{out}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")
