"""Keep a costly parse from being repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name`` so that later filters on it do not bring the expression along.

    A filter on a projected column is pushed below the projection with the expression in place of the
    column, so a parsed record tested field by field would be parsed once per test. Filters on the output
    of a generator stay above it; a one-element array makes the value such an output.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
