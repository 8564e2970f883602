"""Column helpers that shape the optimised plan.

``compute_once`` adds derived columns that must be evaluated exactly once per
row.  Catalyst pushes a ``Filter`` below the ``Project`` that defines the
columns it tests and substitutes their full expressions, so a filter on an
expensive derived column (e.g. ``size(sentences(text)) >= 5``) would
re-tokenise every text inside the filter.  Columns produced by a generator are
not substituted: their filters stay above it.  ``inline`` of a one-element
array is a per-row pass-through that makes the columns generator outputs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **exprs: Column) -> DataFrame:
    keep = [c for c in df.columns if c not in exprs]
    packed = F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))
    return df.select(*keep, F.inline(packed))
