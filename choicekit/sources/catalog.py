"""Named datasets: ``(name, config) -> location + format``, all
splits in one table with a ``split`` partition column.

A catalog entry replaces a hub download: the data sits in shared storage,
partitioned by split, and a split filter prunes partitions at the scan.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    path: str
    fmt: str = "parquet"
    options: tuple[tuple[str, str], ...] = ()


class Catalog:
    def __init__(self) -> None:
        self._entries: dict[tuple[str, str | None], Entry] = {}

    def register(self, name: str, config: str | None, path: str, fmt: str = "parquet",
                 **options: str) -> None:
        self._entries[(name, config)] = Entry(path, fmt, tuple(sorted(options.items())))

    def save(self, df: DataFrame, name: str, config: str | None, path: str) -> None:
        """Write all splits of a dataset partitioned by ``split`` and register it."""
        df.write.mode("overwrite").partitionBy("split").parquet(path)
        self.register(name, config, path)

    def load(self, spark: SparkSession, name: str, config: str | None = None,
             splits: list[str] | None = None) -> DataFrame:
        e = self._entries[(name, config)]
        df = spark.read.format(e.fmt).options(**dict(e.options)).load(e.path)
        return df.where(F.col("split").isin(splits)) if splits else df
