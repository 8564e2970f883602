"""Registered queries: vocabulary encoding, pad/truncate + mask, separator
segments and rejects, mean pooling (M6–M8, A9)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import compute_once
from ..operators import encode as N
from ..operators import subword as SW
from ..sources.files import stage
from ..sources.tables import documents, texts
from . import sqltext as S
from .fixtures import SPLIT_SQL, length_ids, split_of, token_rows, vector_groups, with_ctes, words_of
from .registry import register

PAD_LEN = 512      # sequence length of the reference's longest encoder


@register("vocab_encode", f"""
WITH tok AS (SELECT doc_id, {S.tokens(S.preprocess('text'))} AS t FROM documents),
ex AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tok),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id
          FROM ex WHERE {SPLIT_SQL.format(k='doc_id')} = 'train' GROUP BY token),
enc AS (SELECT ex.doc_id, list(coalesce(v.id, 1) ORDER BY ex.pos) AS ids
        FROM ex LEFT JOIN vocab v ON ex.token = v.token GROUP BY ex.doc_id)
SELECT tok.doc_id, CAST(coalesce(len(enc.ids), 0) AS BIGINT) AS n_ids,
       coalesce(array_to_string(enc.ids, ' '), '') AS ids
FROM tok LEFT JOIN enc ON tok.doc_id = enc.doc_id""")
def q_vocab_encode(spark, sf):
    """Vocabulary learnt on the train split of all languages, applied to all
    documents; words never seen in training encode as the unknown id."""
    docs = stage(texts(spark, sf, "doc_id", "text").select(
        "doc_id", tx.word_tokens(tx.preprocess_text("text")).alias("tokens")), "tokens")
    vocab = N.build_vocabulary(docs.where(split_of("doc_id") == "train"))
    enc = N.encode_tokens(docs, vocab, "doc_id")
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                      F.array_join("ids", " ").alias("ids"))


MIN_COUNT, LONGEST = 20, 16     # of the words of the train split that are pieces


@register("subword_encode", f"""
WITH RECURSIVE tok AS (SELECT doc_id, {S.tokens(S.preprocess('text'))} AS t FROM documents),
ex AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM tok),
train AS (SELECT word, count(*) AS n FROM ex WHERE {SPLIT_SQL.format(k='doc_id')} = 'train' GROUP BY word),
texts AS (SELECT word AS piece FROM train WHERE n >= {MIN_COUNT} AND length(word) <= {LONGEST}
          UNION SELECT DISTINCT unnest(regexp_extract_all(word, '.')) FROM train),
pieces AS (SELECT piece, row_number() OVER (ORDER BY piece) + 1 AS id FROM texts),
words AS (SELECT DISTINCT ex.word, p.id FROM ex LEFT JOIN pieces p ON ex.word = p.piece),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS start FROM words WHERE id IS NULL),
subs AS (SELECT word, start, unnest(range(1, least({LONGEST}, length(word) - start + 1) + 1)) AS size FROM places),
best AS (SELECT s.word, s.start, max(s.size) AS size, arg_max(p.id, s.size) AS id
         FROM subs s JOIN pieces p ON p.piece = substring(s.word, s.start, s.size) GROUP BY s.word, s.start),
walk(word, place, ids) AS (
  SELECT word, CAST(1 AS BIGINT), CAST([] AS BIGINT[]) FROM words WHERE id IS NULL
  UNION ALL
  SELECT w.word, w.place + b.size, list_append(w.ids, b.id) FROM walk w JOIN best b ON b.word = w.word AND b.start = w.place),
done AS (SELECT word, ids FROM walk WHERE place = length(word) + 1
         UNION ALL SELECT word, [id] FROM words WHERE id IS NOT NULL),
enc AS (SELECT ex.doc_id, flatten(list(coalesce(d.ids, [1]) ORDER BY ex.pos)) AS ids
        FROM ex LEFT JOIN done d ON ex.word = d.word GROUP BY ex.doc_id)
SELECT tok.doc_id, CAST(coalesce(len(enc.ids), 0) AS BIGINT) AS n_ids,
       coalesce(array_to_string(enc.ids, ' '), '') AS ids
FROM tok LEFT JOIN enc ON tok.doc_id = enc.doc_id""")
def q_subword_encode(spark, sf):
    """Longest match: the given pieces are the words of the train split that occur
    20 times or more and have at most 16 characters, and its single characters."""
    docs = stage(texts(spark, sf, "doc_id", "text").select(
        "doc_id", tx.word_tokens(tx.preprocess_text("text")).alias("tokens")), "tokens")
    train = docs.where(split_of("doc_id") == "train").select(F.explode("tokens").alias("word")) \
        .groupBy("word").agg(F.count("*").alias("n"))
    frequent = train.where((F.col("n") >= MIN_COUNT) & (F.length("word") <= LONGEST)).select("word")
    letters = train.select(F.explode(F.array_distinct(F.split("word", ""))).alias("word")).where("word <> ''")
    table = N.dense_index(frequent.union(letters).distinct(), [F.col("word").asc()], "_i").select(
        F.col("word").alias("piece"), (F.col("_i") + N.FIRST_ID).alias("id"))
    pieces = table.select("piece", F.explode(F.array(F.lit(False), F.lit(True))).alias("inner"), "id")
    enc = SW.subword_encode(docs, pieces, "doc_id")
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


@register("pad_truncate_mask", f"""
SELECT doc_id, array_to_string(list_resize(t[1:{PAD_LEN}], {PAD_LEN}, 0), ' ') AS ids,
       array_to_string(list_resize(list_transform(t[1:{PAD_LEN}], lambda x: 1), {PAD_LEN}, 0),
                       ' ') AS mask
FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'),
                                                lambda w: w <> ''),
                                    lambda w: CAST(length(w) + 102 AS INTEGER)) AS t
      FROM documents)""")
def q_pad_truncate_mask(spark, sf):
    d = documents(spark, sf, "doc_id", "text").select("doc_id", length_ids(words_of("text")).alias("t"))
    return d.select("doc_id", F.array_join(N.pad_truncate("t", PAD_LEN), " ").alias("ids"),
                    F.array_join(N.attention_mask("t", PAD_LEN), " ").alias("mask"))


_SEG = with_ctes("token_rows") + """,
s AS (SELECT doc_id, ids, list_filter(range(0, len(ids)), lambda i: ids[i + 1] = 102) AS seps
      FROM token_rows)
"""


@register("segment_split", _SEG + """
SELECT doc_id,
       array_to_string(list_resize(ids[2 : seps[1]], len(ids), 0), ' ') AS segment_0,
       array_to_string(list_resize(ids[seps[1] + 2 : seps[2]], len(ids), 0), ' ') AS segment_1,
       array_to_string(list_transform(range(1, len(ids) + 1),
                       lambda i: CASE WHEN i <= seps[1] - 1 THEN 0 ELSE 1 END), ' ') AS mask_0,
       array_to_string(list_transform(range(1, len(ids) + 1),
                       lambda i: CASE WHEN i <= seps[2] - seps[1] - 1 THEN 0 ELSE 1 END), ' ')
         AS mask_1
FROM s WHERE len(seps) = 2""")
def q_segment_split(spark, sf):
    segs, _ = N.split_segments(token_rows(spark, sf))
    return segs.select("doc_id", *[F.array_join(c, " ").alias(c)
                                   for c in ("segment_0", "segment_1", "mask_0", "mask_1")])


_MASK = "array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= {n} THEN 0 ELSE 1 END), ' ')"


@register("segment_split_three", f"""
WITH t AS (SELECT doc_id, list_transform(w, lambda x: CAST(length(x) + 102 AS INTEGER)) AS t
           FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'),
                                            lambda x: x <> '') AS w FROM documents)),
r AS (SELECT doc_id, [101] || t[1:3] || [102] || t[4:6] || [102] || t[7:] ||
             CASE WHEN doc_id % 9 = 0 THEN []::INTEGER[] ELSE [102] END AS ids FROM t),
s AS (SELECT doc_id, ids, list_filter(range(0, len(ids)), lambda i: ids[i + 1] = 102) AS seps FROM r)
SELECT doc_id,
       array_to_string(list_resize(ids[2 : seps[1]], len(ids), 0), ' ') AS segment_0,
       array_to_string(list_resize(ids[seps[1] + 2 : seps[2]], len(ids), 0), ' ') AS segment_1,
       array_to_string(list_resize(ids[seps[2] + 2 : seps[3]], len(ids), 0), ' ') AS segment_2,
       {_MASK.format(n='seps[1] - 1')} AS mask_0, {_MASK.format(n='seps[2] - seps[1] - 1')} AS mask_1,
       {_MASK.format(n='seps[3] - seps[2] - 1')} AS mask_2
FROM s WHERE len(seps) = 3""")
def q_segment_split_three(spark, sf):
    """M8 with three separators: question and option, reason, context."""
    d = compute_once(documents(spark, sf, "doc_id", "text"),
                     w=F.coalesce(words_of("text"), F.array().cast("array<string>"))).drop("text")
    t, sep, none = F.col("t"), F.array(F.lit(102)), F.array().cast("array<int>")
    rows = d.select("doc_id", length_ids("w").alias("t")).select("doc_id", F.concat(
        F.array(F.lit(101)), F.slice(t, 1, 3), sep, F.slice(t, 4, 3), sep, F.slice(t, 7, F.size(t)),
        F.when(F.col("doc_id") % 9 == 0, none).otherwise(sep)).alias("ids"))
    segs, _ = N.split_segments(rows, n_sep=3)
    return segs.select("doc_id", *[F.array_join(f"{c}_{j}", " ").alias(f"{c}_{j}")
                                   for j in range(3) for c in ("segment", "mask")])


@register("segment_rejects", _SEG + """
SELECT doc_id, CAST(len(seps) AS BIGINT) AS n_separators FROM s WHERE len(seps) <> 2""")
def q_segment_rejects(spark, sf):
    _, rejects = N.split_segments(token_rows(spark, sf))
    return rejects


def _pool_sql(denominator: str) -> str:
    return with_ctes("vector_groups") + f"""
SELECT doc_id, CAST(pos AS BIGINT) AS dim, round(sum(x) / {denominator}, 6) AS value
FROM (SELECT doc_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
             unnest(range(len(embedding))) AS pos FROM vector_groups)
GROUP BY doc_id, pos"""


@register("mean_pool", _pool_sql(
    "(SELECT max(c) FROM (SELECT count(*) AS c FROM vector_groups GROUP BY doc_id))"))
def q_mean_pool(spark, sf):
    """Unmasked (the reference): groups padded with zero vectors to the
    longest group, mean over the padded length."""
    g = vector_groups(spark, sf)
    longest = g.groupBy("doc_id").count().select(F.max("count")).scalar()
    return N.mean_pool(g, masked=False, padded_length=longest)


@register("mean_pool_masked", _pool_sql("count(x)"))
def q_mean_pool_masked(spark, sf):
    return N.mean_pool(vector_groups(spark, sf), masked=True)
