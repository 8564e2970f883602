"""Registered queries: text cleaning, tokens, n-grams, list text."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import documents
from . import sqltext as S
from .fixtures import entities, mc_items, with_ctes
from .registry import register


def _docs(spark, sf):
    return documents(spark, sf, "doc_id", "text")


@register("preprocess_text", f"SELECT doc_id, {S.preprocess('text')} AS clean FROM documents")
def q_preprocess_text(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.preprocess_text("text").alias("clean"))


@register("tokens", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, {S.tokens(S.preprocess('text'))} AS t FROM documents)""")
def q_tokens(spark, sf):
    t = tx.word_tokens(tx.preprocess_text("text"))
    return _docs(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.array_join("t", "|").alias("tokens"))


@register("tokens_no_stop", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS tokens
FROM (SELECT doc_id, {S.no_stop('t0')} AS t
      FROM (SELECT doc_id, {S.tokens(S.preprocess('text'))} AS t0 FROM documents))""")
def q_tokens_no_stop(spark, sf):
    t = tx.remove_stop_words(tx.word_tokens(tx.preprocess_text("text")))
    return _docs(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.array_join("t", "|").alias("tokens"))


def _ngram_sql(lo: int, hi: int) -> str:
    return f"""
SELECT doc_id, CAST(len(v) AS BIGINT) AS n_ngrams, array_to_string(v, '|') AS ngrams
FROM (SELECT doc_id, {S.vocabulary('g')} AS v
      FROM (SELECT doc_id, {S.ngrams('t', lo, hi)} AS g
            FROM (SELECT doc_id, {S.no_stop('t0')} AS t
                  FROM (SELECT doc_id, {S.tokens(S.preprocess('text'))} AS t0
                        FROM documents))))"""


def _ngram_query(lo: int, hi: int):
    def run(spark, sf):
        return tx.with_ngram_text(_docs(spark, sf), "text", "v", lo, hi).select(
            "doc_id", F.size("v").cast("bigint").alias("n_ngrams"),
            F.array_join("v", "|").alias("ngrams"))
    return run


register("ngrams_1_1", _ngram_sql(1, 1))(_ngram_query(1, 1))
register("ngrams_1_2", _ngram_sql(1, 2))(_ngram_query(1, 2))


@register("sentences", f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, array_to_string(s, ' ') AS joined
FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)""")
def q_sentences(spark, sf):
    s = tx.sentences("text")
    return _docs(spark, sf).select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("n_sentences"),
        tx.join_sentences("s").alias("joined"))


@register("sentence_map_rejoin", f"""
SELECT doc_id, array_to_string(list_transform(s, lambda x: {S.preprocess('x')}), ' ')
         AS rejoined
FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)""")
def q_sentence_map_rejoin(spark, sf):
    """X14 with an SQL-expressible per-sentence op: ``transform`` keeps the
    order without exploding and regrouping (no shuffle)."""
    s = F.transform(tx.sentences("text"), tx.preprocess_text)
    return _docs(spark, sf).select("doc_id", tx.join_sentences(s).alias("rejoined"))


@register("split_join_options", with_ctes("mc_items") + """
SELECT example_id, CAST(len(string_split(p, '|')) AS BIGINT) AS n_parts_pipe,
       CAST(len(string_split(c, ',')) AS BIGINT) AS n_parts_comma,
       array_to_string(string_split(p, '|'), '|') AS options_text
FROM (SELECT example_id, array_to_string(options, '|') AS p,
             array_to_string(options, ',') AS c FROM mc_items)""")
def q_split_join_options(spark, sf):
    m = mc_items(spark, sf).select("example_id", tx.join_list("options", "|").alias("p"),
                                   tx.join_list("options", ",").alias("c"))
    pipe = tx.split_literal("p", "|")
    return m.select("example_id", F.size(pipe).cast("bigint").alias("n_parts_pipe"),
                    F.size(tx.split_literal("c", ",")).cast("bigint").alias("n_parts_comma"),
                    F.array_join(pipe, "|").alias("options_text"))


@register("remove_delimiter", with_ctes("mc_items") + """
SELECT example_id, a AS answers, CAST(len(string_split(a, ',')) AS BIGINT) AS n_parts
FROM (SELECT example_id,
             array_to_string(list_transform(options, lambda x: replace(x, ',', ' ')), ',') AS a
      FROM mc_items)""")
def q_remove_delimiter(spark, sf):
    a = tx.join_list(tx.replace_in_items("options", ",", " "), ",")
    m = mc_items(spark, sf).select("example_id", a.alias("answers"))
    return m.select("example_id", "answers",
                    F.size(tx.split_literal("answers", ",")).cast("bigint").alias("n_parts"))


def _list_literal(c):
    """Python-style list text of an array of strings: ['a', 'b']."""
    quoted = F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


_LIST_LITERAL_SQL = ("'[' || array_to_string(list_transform(options, lambda x: '''' || x || ''''), "
                     "', ') || ']'")


@register("repair_list_text", with_ctes("mc_items") + f"""
SELECT example_id, CAST(len(r) AS BIGINT) AS n_parts, array_to_string(r, '|') AS parts
FROM (SELECT example_id, string_split(translate({_LIST_LITERAL_SQL}, '''[]', ''), ',') AS r
      FROM mc_items)""")
def q_repair_list_text(spark, sf):
    r = tx.repair_list_text(_list_literal(F.col("options")))
    return mc_items(spark, sf).select("example_id", r.alias("r")).select(
        "example_id", F.size("r").cast("bigint").alias("n_parts"),
        F.array_join("r", "|").alias("parts"))


@register("drop_first_char", with_ctes("mc_items") + f"""
SELECT example_id,
       array_to_string(list_transform(r, lambda x, i: CASE WHEN i BETWEEN 2 AND 4
                                                      THEN substr(x, 2) ELSE x END), '|')
         AS parts
FROM (SELECT example_id, string_split(translate({_LIST_LITERAL_SQL}, '''[]', ''), ',') AS r
      FROM mc_items)""")
def q_drop_first_char(spark, sf):
    r = tx.drop_first_char(tx.repair_list_text(_list_literal(F.col("options"))))
    return mc_items(spark, sf).select("example_id", F.array_join(r, "|").alias("parts"))


@register("entity_text", with_ctes("entities") + """
SELECT entity_id, concat(coalesce(label, ' '), '. ', coalesce(description, ' '), '.') AS text
FROM entities""")
def q_entity_text(spark, sf):
    return entities(spark, sf).select("entity_id",
                                      tx.entity_text("label", "description").alias("text"))
