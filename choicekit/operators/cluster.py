"""Cosine k-means per group, cluster summaries and representatives, global
k-means and a 2-D projection (SURVEY C1–C3, A1, A2, T5, P7).

Per-group k-means runs Lloyd steps for *all* groups at once as DataFrame
operations keyed by ``(group, cluster)``:

* assignment joins each point with its group's k centres (an array of at most
  k structs per group, so the join never multiplies points) and takes the
  best centre with ``array_max`` on ``(sim, -cluster)``;
* the update is a grouped ``Summarizer.mean`` (combines map-side, so a hot
  group is pre-aggregated before the shuffle);
* centres are checkpointed to the shared checkpoint folder every few steps to
  cut lineage (reliable, survives executor loss).

``k_eff = least(k, n)`` per group and empty clusters keep their previous centre
(they are simply absent from the summaries).
"""
from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .similarity import ROUND, as_double, cosine, norm


def prepare(points: DataFrame, key: str, item: str, vec: str) -> DataFrame:
    return points.select(key, item, as_double(vec).alias("vec")) \
        .withColumn("norm", norm(F.col("vec")))


def seed_centres(points: DataFrame, k: int, key: str = "doc_id",
                 item: str = "vec_id") -> DataFrame:
    """The k lowest items of each group are the initial centres 0..k-1."""
    w = Window.partitionBy(key).orderBy(F.col(item))
    return (points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .select(key, (F.col("_r") - 1).cast("bigint").alias("cluster"),
                    F.col("vec").alias("centre"), F.col("norm").alias("c_norm")))


def assign(points: DataFrame, centres: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nearest centre by cosine (rounded), lowest cluster id on ties."""
    per_group = centres.groupBy(key).agg(
        F.collect_list(F.struct("cluster", "centre", "c_norm")).alias("_cs"))
    sims = F.transform("_cs", lambda c: F.struct(
        F.round(cosine(F.col("vec"), c["centre"], F.col("norm"), c["c_norm"]), ROUND)
        .alias("sim"), (-c["cluster"]).alias("neg"), c["cluster"].alias("cluster")))
    best = F.array_max(sims)
    return (points.join(per_group, key)
            .withColumn("_best", best)
            .withColumn("cluster", F.col("_best.cluster"))
            .withColumn("centre_sim", F.col("_best.sim"))
            .drop("_cs", "_best"))


def update_centres(assigned: DataFrame, old: DataFrame, key: str = "doc_id") -> DataFrame:
    means = (assigned.withColumn("_v", array_to_vector("vec"))
             .groupBy(key, "cluster").agg(Summarizer.mean(F.col("_v")).alias("_m"))
             .select(key, "cluster", vector_to_array("_m").alias("new_c")))
    merged = old.join(means, [key, "cluster"], "left")
    centre = F.coalesce(F.col("new_c"), F.col("centre"))
    return merged.select(key, "cluster", centre.alias("centre")) \
        .withColumn("c_norm", norm(F.col("centre")))


def kmeans_grouped(points: DataFrame, k: int, max_iter: int = 10, key: str = "doc_id",
                   item: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Cosine k-means inside every group; returns ``key, item, cluster,
    centre_sim``.  Deterministic (seeded by the lowest items)."""
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    # the points are read by every step: materialise them once (reliable
    # checkpoint in shared storage, survives executor loss)
    p = prepare(points, key, item, vec).checkpoint()
    centres = seed_centres(p, k, key, item)
    for _ in range(max_iter):
        # the centres (k rows a group) are read twice by a step: cut the lineage
        # every time, so that a step's plan doesn't hold the steps before it
        new = update_centres(assign(p, centres, key), centres, key).checkpoint()
        done = new.select(key, "cluster", "centre").exceptAll(
            centres.select(key, "cluster", "centre")).isEmpty()
        centres = new
        if done:
            break
    return assign(p, centres, key).select(key, item, "cluster", "centre_sim")


def cluster_summary(assigned: DataFrame, sims: DataFrame, key: str = "doc_id",
                    item: str = "vec_id") -> DataFrame:
    """A1: per (group, cluster) member count and best pivot similarity."""
    j = assigned.select(key, item, "cluster").join(sims, [key, item])
    return j.groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n_members"),
                                         F.max("sim").alias("max_sim"),
                                         F.min(item).alias(f"min_{item}"))


def cluster_members(assigned: DataFrame, sims: DataFrame, key: str = "doc_id",
                    item: str = "vec_id") -> DataFrame:
    """A1: every member of every cluster with its pivot similarity, one row a
    member (a hot cluster is never gathered into one array)."""
    return assigned.select(key, item, "cluster").join(sims.select(key, item, "sim"), [key, item]) \
        .select(key, "cluster", item, "sim")


def representatives(assigned: DataFrame, sims: DataFrame, key: str = "doc_id",
                    item: str = "vec_id") -> DataFrame:
    """A2/T5: per (group, cluster) the member most similar to the pivot
    (lowest item on ties), as a ``max_by`` aggregate."""
    j = assigned.select(key, item, "cluster").join(sims, [key, item])
    best = F.max_by(F.struct(F.col(item).alias("i"), F.col("sim").alias("s")),
                    F.struct(F.col("sim"), -F.col(item)))
    return j.groupBy(key, "cluster").agg(best.alias("_b")) \
        .select(key, "cluster", F.col("_b.i").alias(item), F.col("_b.s").alias("sim"))


def kmeans_global(df: DataFrame, k: int = 10, vec: str = "embedding", seed: int = 7,
                  max_iter: int = 20) -> DataFrame:
    """MLlib k-means with cosine distance over the whole table."""
    data = df.withColumn("features", array_to_vector(vec))
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=max_iter,
                   featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("features")


def project_2d(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """2-D PCA projection (the scatter-plot coordinates), no plot."""
    data = df.withColumn("features", array_to_vector(vec))
    model = PCA(k=2, inputCol="features", outputCol="_xy").fit(data)
    out = model.transform(data).withColumn("_xy", vector_to_array("_xy"))
    return out.withColumn("x", F.col("_xy")[0]).withColumn("y", F.col("_xy")[1]) \
        .drop("features", "_xy")
