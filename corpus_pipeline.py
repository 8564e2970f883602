"""Corpus pipeline: raw documents to packed token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  What a stage returns is written as Parquet and read again as the
next one's docs, so a lost executor costs tasks of one stage.  The session's Arrow batches
are cut to ``BATCH_ROWS`` rows.

toxicity         documents that the ordinal model, fitted on labels, calls toxic go
near_duplicates  one document (the smallest doc_id) of each group of near copies stays
decontamination  documents that hold a benchmark passage go
mixing           the words of each source come near its target; a row per document and pass
token_output     ids in bit-packed shards; returns what is read back from them
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from choicekit.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from choicekit.llm.common import read, ship, stage

BATCH_ROWS = 2_000      # whole texts on their way to a Python worker at once
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """For stages that read texts in Python.  A batch of texts is held twice in the executor
    and twice in the worker of each of its tasks, so it is kept small."""
    ship(spark)
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return token_output.digest(*token_output.write(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

# The stages learn, hash and tokenise; DuckDB has no SQL for that.  tests/llm holds each
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
