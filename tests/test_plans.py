"""Plan-shape regressions: expensive derived columns are evaluated once,
top-k / limits use a map-side partial group limit, a spread table is regrouped without
a second exchange, and filters/columns reach the Parquet scan."""
import contextlib
import io

from pyspark.sql import functions as F

from choicekit.functions.columns import compute_once
from choicekit.functions import text as tx
from choicekit.operators import similarity as V
from choicekit.plans.fixtures import vector_groups
from choicekit.sources.tables import spread, table


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_compute_once_keeps_expensive_expression_out_of_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = docs.select("doc_id", tx.sentences("text").alias("s")).where(F.size("s") >= 5)
    once = compute_once(docs, s=tx.sentences("text")).where(F.size("s") >= 5)
    assert plan(plain).count("regexp_extract_all") > 1        # duplicated by pushdown
    assert plan(once).count("regexp_extract_all") == 1
    assert plain.count() == once.count()


def test_top_k_uses_partial_group_limit(spark, sf_dir):
    p = plan(V.top_k(V.pivot_similarity(vector_groups(spark, sf_dir)), 3))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_spread_serves_a_later_regroup(spark):
    """One exchange in all, whatever partitions the source has."""
    for df in (spark.range(100).coalesce(1), spark.range(100).repartition(40)):
        p = plan(spread(df, "id").groupBy("id").count())
        assert p.count("hashpartitioning(id") == 1


def test_pushdown_and_pruning_reach_the_scan(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R") \
        .select("l_orderkey", "l_quantity")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in p
