"""Shared helpers: reading tables, stable rows, shared tables, and picking whole rows back by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir, written_once

#: Bytes of text that one batch takes to a Python worker; long texts come in batches of fewer rows.
BATCH_BYTES = 8 << 20

__all__ = ["keep_rows", "read", "small_batches", "shared_dir", "text_or_empty", "wrapped", "written_once"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches hold at most ``BATCH_BYTES``: a worker's memory then depends on
    its longest text, not on how many rows make a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def wrapped(df: DataFrame, **keys: Column) -> DataFrame:
    """The whole row as struct ``row`` beside ``keys``: working columns cannot clash with the caller's."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in keys.items()])


def keep_rows(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wrapped`` whose keys are in ``kept``, each key once.

    ``kept`` has the keys and a boolean ``repeated``: several rows carry this key. Only those rows pay for a
    second shuffle; all others go straight from the join on. Keys compare null-safe.
    """
    k = kept.select(*[F.col(n).alias(f"k_{n}") for n in keys], "repeated")
    on = [F.col(n).eqNullSafe(F.col(f"k_{n}")) for n in keys]
    found = rows.join(k, on, "inner").select("row", *keys, "repeated")
    single = found.where(~F.col("repeated")).select("row.*")
    several = found.where("repeated").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(several)
