"""Encoding: dense frequency-ranked ids, unknown id, pad/truncate/mask,
separator segments and rejects (B15), pooled means (A9)."""
from pyspark.sql import functions as F

from choicekit.operators import encode as N


def test_vocabulary_ids_dense_and_ranked(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "b", "a"])],
                                 "doc_id long, tokens array<string>")
    v = {r.token: r.id for r in N.build_vocabulary(docs).collect()}
    assert v == {"b": 2, "a": 3, "c": 4}
    new = spark.createDataFrame([(3, ["a", "zz", "b"]), (4, [])], "doc_id long, tokens array<string>")
    enc = {r.doc_id: r.ids for r in N.encode_tokens(new, N.build_vocabulary(docs), "doc_id").collect()}
    assert enc == {3: [3, 1, 2], 4: []}


def test_dense_index_many_partitions(spark):
    df = spark.range(1000).repartition(7).withColumn("k", (F.col("id") * 7919) % 1000)
    idx = N.dense_index(df, [F.col("k").asc()], "i").collect()
    assert sorted((r.k, r.i) for r in idx) == [(k, k) for k in range(1000)]


def test_pad_truncate_and_mask(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5, 6],)], "a array<int>")
    r = df.select(N.pad_truncate("a", 4).alias("p"), N.attention_mask("a", 4).alias("m")).collect()
    assert [(x.p, x.m) for x in r] == [([5, 6, 7, 0], [1, 1, 1, 0]), ([1, 2, 3, 4], [1, 1, 1, 1])]


def test_segments_and_rejects(spark):
    df = spark.createDataFrame([(1, [101, 7, 8, 102, 9, 102]), (2, [101, 7, 102, 9])],
                               "doc_id long, ids array<int>")
    segs, rej = N.split_segments(df)
    s = segs.first()
    assert s.segment_0 == [7, 8, 0, 0, 0, 0] and s.segment_1 == [9, 0, 0, 0, 0, 0]
    assert s.mask_0 == [0, 0, 1, 1, 1, 1] and s.mask_1 == [0, 1, 1, 1, 1, 1]
    assert [(r.doc_id, r.n_separators) for r in rej.collect()] == [(2, 1)]
    three = spark.createDataFrame([(1, [101, 7, 102, 8, 102, 9, 102])], "doc_id long, ids array<int>")
    s3, _ = N.split_segments(three, n_sep=3)
    assert s3.first().segment_2[:1] == [9]


def test_mean_pool_masked_and_padded(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "doc_id long, embedding array<double>")
    m = {r.dim: r.value for r in N.mean_pool(df).collect()}
    u = {r.dim: r.value for r in N.mean_pool(df, masked=False, padded_length=4).collect()}
    assert m == {0: 2.0, 1: 3.0} and u == {0: 1.0, 1: 1.5}
