"""Last-seen profile per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Profile field -> event field.
PROFILE = {
    "last_event_type": "event_type",
    "last_category": "category",
    "last_product_id": "product_id",
    "last_device": "device",
}


def latest_profile(events: DataFrame) -> DataFrame:
    """The newest event of each user; equal times go to the greatest event id.

    ``max_by`` over a struct with text is a sort aggregate: each map task sorts its own rows by user and
    sends one row per user, so a hot user costs one row per map task and no task sees all their events. The
    rows are rebalanced before, so what a task sorts has a size that does not follow the files'.
    """
    tie_break = ["event_id"] if "event_id" in events.columns else list(PROFILE.values())
    newest = F.max_by(F.struct("event_ts", *PROFILE.values()), F.struct("event_ts", *tie_break))
    return (
        events.hint("rebalance")
        .groupBy("user_id")
        .agg(newest.alias("e"))
        .select(
            "user_id",
            *[F.col(f"e.{source}").alias(name) for name, source in PROFILE.items()],
            F.unix_millis("e.event_ts").alias("last_seen_ms"),
        )
    )
