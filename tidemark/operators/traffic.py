"""Counters over events, topics and delivery outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_mix(events: DataFrame) -> DataFrame:
    """Share of each event type."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    total = F.sum("events").over(Window.partitionBy())  # one row per event type
    return counts.withColumn("share", F.round(F.col("events") / total, 6))


def top_user_share(events: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Share of events that come from the busiest ``fraction`` of users.

    Users are not ranked one by one: they are grouped by their event count. N events allow at most
    about sqrt(2N) different counts, so ranking those counts is small whatever the number of users.
    """
    per_user = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    levels = per_user.groupBy("events").agg(F.count(F.lit(1)).alias("users"))
    busier = Window.orderBy(F.col("events").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    ranked = levels.select(
        "events",
        "users",
        F.coalesce(F.sum("users").over(busier), F.lit(0)).alias("above"),
        F.ceil(F.sum("users").over(everyone) * F.lit(fraction)).alias("top"),
    )
    picked = F.greatest(F.lit(0), F.least(F.col("users"), F.col("top") - F.col("above")))
    return ranked.agg(
        F.sum("users").alias("users"),
        F.max("top").alias("top_users"),
        F.sum(F.col("users") * F.col("events")).alias("events"),
        F.round(F.sum(picked * F.col("events")) / F.sum(F.col("users") * F.col("events")), 6).alias("top_share"),
    )


def topic_size(raw: DataFrame) -> DataFrame:
    """Messages a topic has received: the end offsets of its partitions, added up."""
    ends = raw.groupBy("partition").agg((F.max("offset") + 1).alias("end_offset"))
    return ends.agg(F.count(F.lit(1)).alias("partitions"), F.sum("end_offset").alias("messages"))


def ingest_rate(raw: DataFrame) -> DataFrame:
    """Messages per minute over the observed span, from the growth of each partition's offsets."""
    growth = raw.groupBy("partition").agg(
        (F.max("offset") - F.min("offset")).alias("grown"),
        F.min("timestamp").alias("since"),
        F.max("timestamp").alias("until"),
    )
    seconds = (F.unix_micros(F.max("until")) - F.unix_micros(F.min("since"))) / F.lit(1e6)
    return growth.agg(
        F.sum("grown").alias("produced"),
        F.bround(F.try_divide(F.sum("grown"), seconds) * 60).cast("bigint").alias("events_per_minute"),
    )


def ingest_per_minute(raw: DataFrame) -> DataFrame:
    minute = F.window("timestamp", "1 minute")
    return raw.groupBy(minute.alias("w")).agg(F.count(F.lit(1)).alias("messages")).select(
        F.col("w.start").alias("minute"), "messages"
    )


def delivery_counters(outcomes: DataFrame) -> DataFrame:
    """``sent, delivered, failed, dlq`` over rows with an ``outcome`` of delivered, failed or dlq."""
    is_ = lambda kind: F.col("outcome") == kind
    return outcomes.agg(
        F.count_if(is_("delivered") | is_("failed")).alias("sent"),
        F.count_if(is_("delivered")).alias("delivered"),
        F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("dlq")).alias("dlq"),
    )


def delivery_rates(outcomes: DataFrame, every: str = "10 seconds", seconds: int = 10) -> DataFrame:
    """Delivered events per second and per minute in each reporting interval."""
    delivered = outcomes.where(F.col("outcome") == "delivered")
    counts = delivered.groupBy(F.window("timestamp", every).alias("w")).agg(F.count(F.lit(1)).alias("delivered"))
    return counts.select(
        F.col("w.start").alias("interval_start"),
        "delivered",
        F.round(F.col("delivered") / seconds, 3).alias("per_second"),
        F.round(F.col("delivered") / seconds * 60, 3).alias("per_minute"),
    )
