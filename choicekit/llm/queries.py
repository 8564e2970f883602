"""Registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, best_fit, chat_format, decontaminate, divergence, hard_negatives, hmm_lm, language_id, mixing, ngram_join, token_output, toxicity, url_filter
from .common import read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return add


@query("op7_ngram_join")
def op7(spark, sf_dir):
    return ngram_join.with_components(read(spark, sf_dir, "documents"))


@query("op8_token_output")
def op8(spark, sf_dir):
    return token_output.digest(*token_output.write(read(spark, sf_dir, "documents")))


@query("op9_mixing")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(mixing.plan(docs))


def listed_urls(pages):
    """The list of the query: canonical urls of pages on hosts that a hyphenated label
    marks as bulk mail hosts."""
    host = url_filter.host_of(F.col("url"))
    return pages.where(host.rlike(r"(^|\.)[a-z]+-[a-z]+\.")).select(
        url_filter.canonical(F.col("url")).alias("canon"))


@query("op4_url_filter")
def op4(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (
  SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l')) AS n,
         CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS first_of_block
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE WHEN first_of_block = 1
                         THEN length('<turn><says></turn>') + 1 + length(role)
                         ELSE length('<more>') END) AS BIGINT) AS formatted_chars,
       CAST(sum(first_of_block) AS BIGINT) AS n_blocks
FROM u GROUP BY conv_id"""


@query("op5_chat_format", CHAT_SQL)
def op5(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.format_conversations(rows)
    out = out.withColumn("turns", chat_format.turns_of(F.col("formatted"))) \
        .withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@query("op6_language_id")
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = _remainder(3) == 1
    model = language_id.fit(docs.where(~F.coalesce(held, F.lit(False))))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_hmm_lm")
def op2(spark, sf_dir):
    return hmm_lm.score(read(spark, sf_dir, "documents"))


@query("op3_ann")
def op3(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), lambda v: v % 20 == 0)


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_best_fit")
def op12(spark, sf_dir):
    return best_fit.digest(best_fit.pack(read(spark, sf_dir, "documents")))


AUDIT_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT lang, source, rid, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                          'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM o WHERE part = 'pair' OR rank <= 50"""


@query("op13_divergence", AUDIT_SQL)
def op13(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label
           AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark, sf_dir):
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))
