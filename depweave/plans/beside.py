"""Aggregates of several tables in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(*parts: DataFrame) -> DataFrame:
    """The columns of tables of one row each, in one row; no join is needed."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*(F.max(c).alias(c) for p in parts for c in p.columns))
