"""choicekit — Spark-native preparation, enrichment and scoring of
multiple-choice reading-comprehension datasets.

Every public function takes and returns DataFrames (or Columns) and is
parameterised by column names, so steps compose with ``DataFrame.transform``.
"""

__version__ = "0.1.0"
