"""Registered queries: cosine similarity, top-k, top-1, pivot union, cluster
assignment, summaries, representatives, tags, k-means, projection."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import kmeans as KM
from ..operators import reshape as R
from ..operators import similarity as V
from ..sources.tables import table
from .fixtures import vector_groups, with_ctes
from .registry import register

K_SEEDS = 3

# ----------------------------------------------------------------- SQL parts
_VEC = f"""
pts AS (SELECT doc_id, vec_id, is_pivot, v,
               sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
        FROM (SELECT doc_id, vec_id, is_pivot, CAST(embedding AS DOUBLE[]) AS v
              FROM vector_groups)),
sims AS (SELECT c.doc_id, c.vec_id,
                round(list_sum(list_transform(range(1, len(c.v) + 1),
                      lambda i: c.v[i] * p.v[i])) / greatest(c.n * p.n, 1e-8), 6) AS sim
         FROM pts c JOIN pts p ON c.doc_id = p.doc_id AND p.is_pivot
         WHERE NOT c.is_pivot),
seeds AS (SELECT doc_id, CAST(r - 1 AS BIGINT) AS cluster, v AS cv, n AS cn
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) AS r
                FROM pts WHERE NOT is_pivot) WHERE r <= {K_SEEDS}),
assigned AS (
  SELECT doc_id, vec_id, cluster, centre_sim FROM (
    SELECT c.doc_id, c.vec_id, s.cluster,
           round(list_sum(list_transform(range(1, len(c.v) + 1),
                 lambda i: c.v[i] * s.cv[i])) / greatest(c.n * s.cn, 1e-8), 6) AS centre_sim,
           row_number() OVER (PARTITION BY c.doc_id, c.vec_id
                              ORDER BY centre_sim DESC, s.cluster) AS r
    FROM pts c JOIN seeds s ON c.doc_id = s.doc_id WHERE NOT c.is_pivot) WHERE r = 1),
reps AS (
  SELECT doc_id, cluster, vec_id, sim FROM (
    SELECT a.doc_id, a.cluster, a.vec_id, s.sim,
           row_number() OVER (PARTITION BY a.doc_id, a.cluster ORDER BY s.sim DESC, a.vec_id) AS r
    FROM assigned a JOIN sims s ON a.doc_id = s.doc_id AND a.vec_id = s.vec_id) WHERE r = 1)
"""


def _with():
    return with_ctes("vector_groups").rstrip("\n") + ",\n" + _VEC


def _candidates(spark, sf):
    return vector_groups(spark, sf).where(~F.col("is_pivot"))


def _sims(spark, sf):
    return V.pivot_similarity(vector_groups(spark, sf))


def _assigned(spark, sf):
    p = C.prepare(_candidates(spark, sf), "doc_id", "vec_id", "embedding")
    return C.assign(p, C.seed_centres(p, K_SEEDS))


@register("cosine_pivot", _with() + "SELECT doc_id, vec_id, sim FROM sims")
def q_cosine_pivot(spark, sf):
    return _sims(spark, sf)


@register("topk_similar", _with() + """
SELECT doc_id, CAST(r AS BIGINT) AS rank, vec_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, vec_id) AS r FROM sims)
WHERE r <= 3""")
def q_topk_similar(spark, sf):
    return V.top_k(_sims(spark, sf), 3)


@register("top1_concept", _with() + """
SELECT doc_id, vec_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, vec_id) AS r FROM sims)
WHERE r = 1""")
def q_top1_concept(spark, sf):
    return V.top_1(_sims(spark, sf))


@register("union_pivot", with_ctes("vector_groups") + """
SELECT doc_id, vec_id, CASE WHEN is_pivot THEN 'document' ELSE 'word' END AS kind
FROM vector_groups""")
def q_union_pivot(spark, sf):
    return V.append_pivot(vector_groups(spark, sf))


@register("cluster_assign_step", _with() + "SELECT * FROM assigned")
def q_cluster_assign_step(spark, sf):
    return _assigned(spark, sf).select("doc_id", "vec_id", "cluster", "centre_sim")


@register("cluster_groups", _with() + """
SELECT a.doc_id, a.cluster, count(*) AS n_members, max(s.sim) AS max_sim,
       min(a.vec_id) AS min_vec_id
FROM assigned a JOIN sims s ON a.doc_id = s.doc_id AND a.vec_id = s.vec_id
GROUP BY a.doc_id, a.cluster""")
def q_cluster_groups(spark, sf):
    return C.cluster_summary(_assigned(spark, sf), _sims(spark, sf))


@register("cluster_members", _with() + """
SELECT a.doc_id, a.cluster, a.vec_id, s.sim
FROM assigned a JOIN sims s ON a.doc_id = s.doc_id AND a.vec_id = s.vec_id""")
def q_cluster_members(spark, sf):
    return C.cluster_members(_assigned(spark, sf), _sims(spark, sf))


@register("cluster_representatives", _with() + "SELECT * FROM reps")
def q_cluster_representatives(spark, sf):
    return C.representatives(_assigned(spark, sf), _sims(spark, sf))


@register("tag_column", _with() + """
SELECT p.doc_id, p.vec_id,
       CASE WHEN p.is_pivot THEN 'document' WHEN r.vec_id IS NOT NULL THEN 'top_cluster'
            ELSE 'word' END AS tag
FROM pts p LEFT JOIN reps r ON p.doc_id = r.doc_id AND p.vec_id = r.vec_id""")
def q_tag_column(spark, sf):
    reps = C.representatives(_assigned(spark, sf), _sims(spark, sf)) \
        .select("doc_id", "vec_id", F.lit(True).alias("is_rep"))
    g = vector_groups(spark, sf).join(reps, ["doc_id", "vec_id"], "left")
    tag = R.tag_column(F.col("is_pivot"), "document",
                       F.when(F.col("is_rep").isNotNull(), F.lit("top_cluster"))
                       .otherwise(F.lit("word")))
    return g.select("doc_id", "vec_id", tag.alias("tag"))


# Rows-only checks: iterative / randomised algorithms (property tests in tests/).
@register("cosine_kmeans_grouped")
def q_cosine_kmeans_grouped(spark, sf):
    return C.kmeans_grouped(_candidates(spark, sf), k=K_SEEDS, max_iter=25)


@register("cosine_kmeans_restarts")
def q_cosine_kmeans_restarts(spark, sf):
    """C1 as the reference runs it: ten clusters, 25 restarts, the best objective kept."""
    members, report = KM.kmeans_restarts(_candidates(spark, sf), k=10, restarts=25)
    best = report.where("kept").select("doc_id", "objective", "converged")
    return members.join(best, "doc_id").select("doc_id", "vec_id", "cluster", F.round("centre_sim", 6).alias("centre_sim"),
                                               "restart", F.round("objective", 6).alias("objective"), "converged")


@register("cosine_kmeans_global")
def q_cosine_kmeans_global(spark, sf):
    e = table(spark, sf, "embeddings")
    return C.kmeans_global(e, k=10).select("vec_id", "label", "cluster")


@register("project_2d")
def q_project_2d(spark, sf):
    e = table(spark, sf, "embeddings")
    clustered = C.kmeans_global(e, k=10)
    return C.project_2d(clustered).select("vec_id", "label", "cluster",
                                          F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
