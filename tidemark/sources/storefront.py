"""The given ``events`` table read as storefront events (latest contract shape)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The storefront vocabulary.
CATEGORIES = 8  # categories are numbered by product
DEVICES = [None, "web", "ios", "android"]  # None: written by a client of the first contract version
EVENT_TYPES = {"view": "view", "click": "add_to_cart", "purchase": "purchase", "error": "refund"}


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``u000042``, ``p00007``: zero-padded, and never cut when the number outgrows the width."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.lit(width) - F.length(digits)), digits)


def storefront(events: DataFrame) -> DataFrame:
    """Rename and derive columns only: a projection that stays inside the scan stage."""
    product = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.col("event_type")
    for source, target in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == source, F.lit(target)).otherwise(kind)
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        padded_id("u", F.col("user_id"), 6).alias("user_id"),
        kind.alias("event_type"),
        padded_id("p", product, 5).alias("product_id"),
        F.concat(F.lit("category-"), F.pmod(product, F.lit(CATEGORIES)).cast("string")).alias("category"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.lit(None).cast("string").alias("session_id"),
        F.element_at(F.array(*map(F.lit, DEVICES)), (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("device"),
    )
