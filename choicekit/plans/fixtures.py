"""Test inputs derived from the driver tables (see FIXTURES.md part B).

Each fixture exists twice: a Spark builder (``mc_items(spark, sf_dir)``) and
the equivalent DuckDB common-table expression in ``SQL``.  Registered queries
compose the Spark builder with an operator; their oracle composes the CTE with
the same logic in SQL.  Both grow with the driver tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import compute_once
from ..sources.tables import documents, table, texts

SPLIT_SQL = ("CASE WHEN {k} % 10 < 8 THEN 'train' WHEN {k} % 10 = 8 "
             "THEN 'validation' ELSE 'test' END")


def split_of(key) -> F.Column:
    """train / validation / test by ``key % 10`` (0–7, 8, 9)."""
    m = F.col(key) % 10
    return F.when(m < 8, "train").when(m == 8, "validation").otherwise("test")


# --------------------------------------------------------------------------
# mc_items: one wide multiple-choice item per five consecutive sentences
# --------------------------------------------------------------------------
BLOCKS = 1 << 20      # example_id = doc_id * BLOCKS + number of the item in its document


def mc_items(spark: SparkSession, sf: str) -> DataFrame:
    return mc_items_from(texts(spark, sf, "doc_id", "text"))


def _sentences(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    return compute_once(docs, snt=tx.sentences("text", collapse_whitespace=True)).drop("text")


def mc_items_from(documents: DataFrame) -> DataFrame:
    """The item derivation on any documents frame (batch or streaming): every
    five sentences of a document are a passage; its first sentence asks, the
    others are the options.  ``mc_item_rejects`` holds what is left over."""
    five = F.transform(F.sequence(F.lit(0), F.floor(F.size("snt") / 5).cast("int") - 1),
                       lambda b: F.slice("snt", b * 5 + 1, F.lit(5)))
    s = _sentences(documents).where(F.size("snt") >= 5) \
        .select("doc_id", F.posexplode(five).alias("b", "s"))
    n = F.col("doc_id") + F.col("b")
    letter = F.when(n % 7 == 0, 4).otherwise(n % 4)
    return s.select((F.col("doc_id") * BLOCKS + F.col("b")).alias("example_id"),
                    F.array_join("s", " ").alias("article"),
                    F.col("s")[0].alias("question"),
                    F.slice("s", 2, 4).alias("options"),
                    (n % 4).cast("int").alias("correct_answer_id"),
                    F.substring(F.lit("ABCDE"), (letter + 1).cast("int"), 1).alias("answer"),
                    split_of("doc_id").alias("split"))


def mc_item_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences after a document's last item, and documents without any."""
    s = _sentences(documents(spark, sf, "doc_id", "text")) \
        .select("doc_id", F.coalesce("snt", F.array().cast("array<string>")).alias("snt"))
    left = F.size("snt") % 5
    return s.where((left > 0) | (F.size("snt") == 0)).select(
        "doc_id", left.cast("bigint").alias("n_left"),
        F.array_join(F.slice("snt", F.size("snt") - left + 1, left), " ").alias("left_over"))


# --------------------------------------------------------------------------
# kg_edges: brand -> nation edges weighted by quantity, nation -> region
# --------------------------------------------------------------------------
def kg_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag",
                                             "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    # pre-aggregate the fact table before each join so shuffles carry partial sums
    by_part = (li.groupBy("l_partkey", "l_suppkey", "l_returnflag")
               .agg(F.sum("l_quantity").alias("q")))
    by_brand = (by_part.join(part, by_part.l_partkey == part.p_partkey)
                .groupBy("p_brand", "l_suppkey", "l_returnflag").agg(F.sum("q").alias("q")))
    brand_edges = (by_brand.join(supp, by_brand.l_suppkey == supp.s_suppkey)
                   .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                   .groupBy("p_brand", "n_name", "n_nationkey", "l_returnflag")
                   .agg(F.round(F.sum("q"), 2).alias("weight"))
                   .select(F.col("p_brand").alias("start_text"),
                           F.lit("en").alias("start_lang"),
                           F.col("n_name").alias("end_text"),
                           F.when(F.col("n_nationkey") % 5 == 0, "es").otherwise("en")
                           .alias("end_lang"),
                           F.col("l_returnflag").alias("relation"),
                           F.col("weight")))
    part_of = (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
               .select(F.col("n_name").alias("start_text"), F.lit("en").alias("start_lang"),
                       F.col("r_name").alias("end_text"), F.lit("en").alias("end_lang"),
                       F.lit("PartOf").alias("relation"), F.lit(1.0).alias("weight")))
    return brand_edges.unionByName(part_of)


def kg_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(word, target) pairs: brands ordered by a customer, with the customer's
    nation and region as targets (one-hop, two-hop and unreachable cases)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    brand_cust = (li.join(part, li.l_partkey == part.p_partkey)
                  .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                  .select("p_brand", "o_custkey").distinct())
    brand_nation = (brand_cust.join(cust, F.col("o_custkey") == F.col("c_custkey"))
                    .select("p_brand", "c_nationkey").distinct()
                    .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                    .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    return (brand_nation.select(F.col("p_brand").alias("word"), F.col("n_name").alias("target"))
            .unionByName(brand_nation.select(F.col("p_brand").alias("word"),
                                             F.col("r_name").alias("target")))
            .distinct())


# --------------------------------------------------------------------------
# kg_words: a graph that grows with the documents, with hubs and self edges
# --------------------------------------------------------------------------
def _doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "doc_id", "text", "lang")
    return compute_once(d, t=tx.word_tokens(tx.preprocess_text("text"))).drop("text")


def kg_words(spark: SparkSession, sf: str) -> DataFrame:
    """An edge from a word to each word that follows it, weighted by how often, in the
    language of the text; frequent words are hubs, repeated words have self edges."""
    t = F.col("t")
    pairs = _doc_tokens(spark, sf).where(F.size(t) > 1).select(
        F.coalesce("lang", F.lit("en")).alias("end_lang"),
        F.inline(F.arrays_zip(F.slice(t, 1, F.size(t) - 1).alias("start_text"),
                              F.slice(t, 2, F.size(t) - 1).alias("end_text"))))
    return pairs.groupBy("start_text", "end_text", "end_lang").agg(F.count(F.lit(1)).cast("double").alias("weight")) \
        .select("start_text", F.lit("en").alias("start_lang"), "end_text", "end_lang",
                F.lit("Next").alias("relation"), "weight")


def kg_word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(word, target): first and last, and second and middle word of every document."""
    t = F.col("t")
    ends = F.array(F.struct(t[0].alias("word"), F.element_at(t, -1).alias("target")),
                   F.struct(t[1].alias("word"), t[F.floor(F.size(t) / 2).cast("int")].alias("target")))
    return _doc_tokens(spark, sf).where(F.size(t) > 1).select(F.inline(ends)).distinct()


# --------------------------------------------------------------------------
# entities: entity search results keyed by a search term
# --------------------------------------------------------------------------
def search_term() -> F.Column:
    """Brand and block of 200 parts: about eight parts share a term at any scale."""
    return F.concat("p_brand", F.lit(" "), F.floor(F.col("p_partkey") / 200).cast("string"))


def n_vectors(spark: SparkSession, sf: str) -> F.Column:
    """Number of vectors, so that ids taken modulo it reach every one of them."""
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()


def entities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("entity_id"),
        search_term().alias("search_term"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("p_name"))
        .alias("label"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit(None))
        .otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("description"),
        (F.col("p_partkey") % n_vectors(spark, sf)).alias("vec_id"))


ENTITY_QUERY_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def entity_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts to look up, one per line item: the term of its part (lines of
    orders whose key is divisible by 13 ask for a concept that is not in the
    entity table); the pivot vector is chosen by the line."""
    li = table(spark, sf, "lineitem").select(*ENTITY_QUERY_KEY)
    part = table(spark, sf, "part").select("p_partkey", search_term().alias("term"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(*ENTITY_QUERY_KEY,
                    F.when(F.col("l_orderkey") % 13 == 0,
                           F.concat(F.col("term"), F.lit(" unknown")))
                    .otherwise(F.col("term")).alias("concept"),
                    ((F.col("l_orderkey") + F.col("l_linenumber")) % n_vectors(spark, sf))
                    .alias("pivot_vec_id")))


def word_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose search terms are the words of the documents: up to three
    per word, described by the first document of their third."""
    d = documents(spark, sf, "doc_id", "text")
    w = d.select("doc_id", F.explode(F.array_distinct(tx.word_tokens(tx.preprocess_text("text"))))
                 .alias("word"))
    first = w.groupBy("word", (F.col("doc_id") % 3).alias("third")).agg(F.min("doc_id").alias("d"))
    return first.select(F.xxhash64("word", "third").alias("entity_id"),
                        F.col("word").alias("search_term"), F.col("word").alias("label"),
                        F.concat(F.lit("word of document "), F.col("d").cast("string"))
                        .alias("description"))


# --------------------------------------------------------------------------
# vector_groups: a "document" (label) with its candidate vectors
# --------------------------------------------------------------------------
def vector_groups(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id = label; the lowest vec_id of a group is its pivot (document
    vector), the others are candidates (n-gram vectors)."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    first = e.groupBy("label").agg(F.min("vec_id").alias("pivot_id"))
    return (e.join(first, "label")
            .select(F.col("label").alias("doc_id"), "vec_id", "embedding",
                    (F.col("vec_id") == F.col("pivot_id")).alias("is_pivot")))


# --------------------------------------------------------------------------
# predictions: one row per (order, line) = (item, choice) with a logit
# --------------------------------------------------------------------------
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                             "l_suppkey", "l_discount", "l_tax")
    w = Window.partitionBy("l_orderkey")
    ranked = li.select(
        F.col("l_orderkey").alias("item_id"),
        (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
        .cast("bigint").alias("choice_idx"),
        F.count(F.lit(1)).over(w).alias("n_choices"),
        F.round(F.col("l_discount") * 10 - F.col("l_tax") * 10, 6).alias("logit"))
    return ranked.select(
        "item_id", "choice_idx", "n_choices", "logit",
        F.when(F.col("choice_idx") == F.col("item_id") % F.col("n_choices"), 1)
        .otherwise(0).cast("int").alias("label"),
        split_of("item_id").alias("split"))


# --------------------------------------------------------------------------
# run_metrics: per-run, per-epoch validation metrics from the event stream
# --------------------------------------------------------------------------
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of a user is one epoch of that user's run, in time order.  Events are
    numbered inside the days of a user, after a count of the days before, so that no
    window holds all events of a user."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "value",
                                           F.to_date("ts").alias("day"))
    days = ev.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    first = days.select("user_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    ranked = ev.join(first.withColumnRenamed("user_id", "u").withColumnRenamed("day", "d"),
                     F.col("user_id").eqNullSafe(F.col("u")) & F.col("day").eqNullSafe(F.col("d"))) \
        .withColumn("epoch", (F.col("first") + F.row_number().over(inside) - 1).cast("bigint"))
    return ranked.select(
        F.col("user_id").alias("run_id"), "epoch",
        F.col("value").alias("val_loss"),
        F.round(1 / (1 + F.col("value")), 6).alias("val_accuracy"),
        (10 + F.col("event_id") % 7).alias("n"),
        F.concat(F.lit("ckpt-"), F.col("user_id").cast("string"), F.lit("-"),
                 F.col("epoch").cast("string")).alias("checkpoint"))


# --------------------------------------------------------------------------
# token_rows: [CLS] a a a [SEP] b b ... b [SEP] with word-length token ids
# --------------------------------------------------------------------------
WORD_SPLIT = r"[ \t\n\r]+"


def words_of(c) -> F.Column:
    return F.filter(F.split(F.col(c), WORD_SPLIT, -1), lambda w: w != "")


def length_ids(words) -> F.Column:
    """A token id per word: its length above the reserved ids (0..102)."""
    return F.transform(words, lambda x: F.length(x) + 102)


def token_rows(spark: SparkSession, sf: str, cls: int = 101, sep: int = 102) -> DataFrame:
    d = compute_once(documents(spark, sf, "doc_id", "text"),
                     w=F.coalesce(words_of("text"), F.array().cast("array<string>"))).drop("text")
    body = d.select("doc_id", length_ids("w").alias("t"))
    last = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<int>")) \
        .otherwise(F.array(F.lit(sep)))
    # first segment: the first three words; second: every remaining word
    return body.select("doc_id", F.concat(F.array(F.lit(cls)), F.slice("t", 1, 3),
                                          F.array(F.lit(sep)),
                                          F.slice("t", 4, F.size("t")), last).alias("ids"))


# ==========================================================================
# DuckDB common-table expressions (same derivations, SQL text)
# ==========================================================================
SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def _sql(name: str, body: str, deps: tuple[str, ...] = ()) -> None:
    SQL[name] = (body, deps)


_sql("mc_sentences", """
SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'),
                           lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))),
                           lambda y: y <> '') AS snt
FROM documents""")

_sql("mc_items", f"""
SELECT doc_id * {BLOCKS} + b AS example_id, array_to_string(s, ' ') AS article,
       s[1] AS question, s[2:5] AS options,
       CAST((doc_id + b) % 4 AS INTEGER) AS correct_answer_id,
       substr('ABCDE', CAST(CASE WHEN (doc_id + b) % 7 = 0 THEN 4 ELSE (doc_id + b) % 4 END
                            AS INTEGER) + 1, 1) AS answer,
       {SPLIT_SQL.format(k='doc_id')} AS split
FROM (SELECT doc_id, b, snt[5 * b + 1 : 5 * b + 5] AS s
      FROM (SELECT doc_id, snt, unnest(range(len(snt) // 5)) AS b FROM mc_sentences))""",
     ("mc_sentences",))

_sql("kg_edges", """
SELECT p_brand AS start_text, 'en' AS start_lang, n_name AS end_text,
       CASE WHEN n_nationkey % 5 = 0 THEN 'es' ELSE 'en' END AS end_lang,
       l_returnflag AS relation, round(sum(l_quantity), 2) AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
     JOIN nation ON s_nationkey = n_nationkey
GROUP BY p_brand, n_name, n_nationkey, l_returnflag
UNION ALL
SELECT n_name, 'en', r_name, 'en', 'PartOf', 1.0
FROM nation JOIN region ON n_regionkey = r_regionkey""")

_sql("kg_pairs", """
SELECT DISTINCT word, target FROM (
  SELECT p_brand AS word, n_name AS target FROM kg_brand_nation
  UNION ALL
  SELECT p_brand AS word, r_name AS target FROM kg_brand_nation)""", ("kg_brand_nation",))

_sql("kg_brand_nation", """
SELECT DISTINCT p_brand, n_name, r_name
FROM lineitem JOIN part ON l_partkey = p_partkey
     JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

_DOC_TOKENS = """(SELECT coalesce(lang, 'en') AS lang, regexp_extract_all(
  regexp_replace(lower(text), '\\p{Nd}+', '', 'g'), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents)"""

_sql("kg_words", f"""
SELECT a AS start_text, 'en' AS start_lang, b AS end_text, lang AS end_lang, 'Next' AS relation,
       CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT lang, unnest(t) AS a, unnest(t[2:]) AS b FROM {_DOC_TOKENS} WHERE len(t) > 1)
WHERE b IS NOT NULL GROUP BY a, b, lang""")

_sql("kg_word_pairs", f"""
SELECT t[1] AS word, t[-1] AS target FROM {_DOC_TOKENS} WHERE len(t) > 1
UNION SELECT t[2], t[len(t) // 2 + 1] FROM {_DOC_TOKENS} WHERE len(t) > 1""")

_sql("entities", """
SELECT p_partkey AS entity_id,
       p_brand || ' ' || CAST(p_partkey // 200 AS VARCHAR) AS search_term,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS label,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat_ws(' ', p_type, p_brand) END
         AS description,
       p_partkey % (SELECT count(*) FROM embeddings) AS vec_id
FROM part""")

_sql("entity_queries", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_orderkey % 13 = 0 THEN concat(term, ' unknown') ELSE term END AS concept,
       (l_orderkey + l_linenumber) % (SELECT count(*) FROM embeddings) AS pivot_vec_id
FROM lineitem JOIN (SELECT p_partkey, p_brand || ' ' || CAST(p_partkey // 200 AS VARCHAR) AS term
                    FROM part) ON l_partkey = p_partkey""")

_sql("vector_groups", """
SELECT e.label AS doc_id, e.vec_id, e.embedding, e.vec_id = f.pivot_id AS is_pivot
FROM embeddings e JOIN (SELECT label, min(vec_id) AS pivot_id FROM embeddings GROUP BY label) f
  ON e.label = f.label""")

_sql("predictions", f"""
SELECT item_id, choice_idx, n_choices, logit,
       CAST(CASE WHEN choice_idx = item_id % n_choices THEN 1 ELSE 0 END AS INTEGER) AS label,
       {SPLIT_SQL.format(k='item_id')} AS split
FROM (SELECT l_orderkey AS item_id,
             CAST(row_number() OVER (PARTITION BY l_orderkey
                  ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS choice_idx,
             count(*) OVER (PARTITION BY l_orderkey) AS n_choices,
             round(l_discount * 10 - l_tax * 10, 6) AS logit
      FROM lineitem)""")

_sql("run_metrics", """
SELECT user_id AS run_id, epoch, value AS val_loss, round(1 / (1 + value), 6) AS val_accuracy,
       10 + event_id % 7 AS n, 'ckpt-' || user_id || '-' || epoch AS checkpoint
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
                     AS BIGINT) AS epoch
      FROM events)""")

_sql("token_rows", """
SELECT doc_id,
       [101] || t[1:3] || [102] || t[4:] ||
       CASE WHEN doc_id % 9 = 0 THEN []::INTEGER[] ELSE [102] END AS ids
FROM (SELECT doc_id, list_transform(w, lambda x: CAST(length(x) + 102 AS INTEGER)) AS t
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'),
                                       lambda x: x <> '') AS w FROM documents))""")


def with_ctes(*names: str) -> str:
    """A ``WITH`` clause holding the named CTEs and their dependencies."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in SQL[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n][0]})" for n in order) + "\n"
