"""Driver parquet tables (one file per table under an ``sf`` folder)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filters reach the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` hash-partitioned on ``key`` for CPU-heavy per-row work (tokenising,
    sentence splitting) on tables of few large row groups; a later regroup by
    that key needs no second shuffle.  AQE sizes the partitions."""
    return df.repartition(key)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table pruned to ``columns`` (with doc_id) and spread for text
    work: the given tables are one file with one row group each."""
    d = table(spark, sf_dir, "documents")
    return spread(d.select(*columns) if columns else d, "doc_id")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table pruned to ``columns`` (with doc_id) for text work row by row: as
    its files deal it where that keeps the cores about evenly busy, spread otherwise."""
    d = table(spark, sf_dir, "documents").select(*columns)
    # rows of each task of the scan, from the footers; parts of a row group are empty tasks
    dealt = d.groupBy(F.spark_partition_id()).count()
    tasks, most, rows = dealt.agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    even = tasks >= (cores := spark.sparkContext.defaultParallelism) and most * cores <= 2 * rows
    return d if even else spread(d, "doc_id")
