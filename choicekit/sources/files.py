"""CSV / TSV and stage-Parquet sources and sinks.

Free text holds newlines, quotes and delimiters, so CSV is always written with
every field quoted and ``"`` as the escape, and read back with an explicit
schema and ``multiLine``; with those settings a table round-trips exactly.
Lists stay ``ARRAY<STRING>`` inside Spark and are joined/split with a literal
delimiter only at the CSV edge (``to_delimited`` / ``from_delimited``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..session import shared_dir

# Nulls are written as an explicit marker so that an empty string and a null
# stay distinct through a round trip (a text equal to the marker reads as null).
NULL_MARKER = "\\N"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "nullValue": NULL_MARKER}


def write_csv(df: DataFrame, path: str, sep: str = ",", partition_by: str | None = None,
              mode: str = "overwrite") -> str:
    """Header, all fields quoted, no index column."""
    w = (df.write.mode(mode).options(**CSV_OPTIONS).option("sep", sep)
         .option("quoteAll", "true")
         # the writer trims surrounding blanks unless told not to
         .option("ignoreLeadingWhiteSpace", "false")
         .option("ignoreTrailingWhiteSpace", "false"))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             sep: str = ",") -> DataFrame:
    """Explicit schema, multi-line quoted fields."""
    return (spark.read.schema(schema).options(**CSV_OPTIONS).option("sep", sep)
            .option("multiLine", "true").csv(path))


def to_delimited(df: DataFrame, columns: list[str], delimiter: str) -> DataFrame:
    """Arrays -> delimited strings at a CSV boundary."""
    return df.select(*[tx.join_list(c, delimiter).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def from_delimited(df: DataFrame, columns: list[str], delimiter: str) -> DataFrame:
    """Delimited strings -> arrays after a CSV read."""
    return df.select(*[tx.split_literal(c, delimiter).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Materialise an enrichment stage as Parquet (cuts lineage before the
    next expensive step; a failed run restarts from the last stage)."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint dir and
    return the re-read frame (partition column last, as Parquet discovery
    returns it)."""
    spark = df.sparkSession
    path = write_stage(df, shared_dir(spark, name), partition_by)
    return spark.read.parquet(path)
