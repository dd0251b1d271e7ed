"""Per-user sliding-window features and the choice of the window to serve."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import to_micros
from tidemark.functions.money import money_merge, money_sums, money_total
from tidemark.session import tasks_for

# Output names and the event types they stand for.
COUNTED = {"view_count": "view", "cart_count": "add_to_cart", "purchase_count": "purchase"}
SUMMED = {"spend": "purchase", "refund_amount": "refund"}
DISTINCT = {"distinct_products": "product_id", "distinct_categories": "category"}

BLOCK = 256  # window lengths of one user that are worked on together
ROWS = 500_000  # (event, window) pairs that one task takes
SKETCH_LG_K = 11  # about 1.8 % standard error, inside the 5 % the features promise


def _measures() -> list[Column]:
    kind = F.col("event_type")
    counts = [F.count_if(kind == value).alias(name) for name, value in COUNTED.items()]
    money = [part for name, value in SUMMED.items() for part in money_sums(kind == value, F.col("amount"), name)]
    return [F.count(F.lit(1)).alias("event_count"), *counts, *money, F.max("event_ts").alias("last_event_ts")]


def _merged_measures() -> list[Column]:
    counts = [F.sum(name).alias(name) for name in ["event_count", *COUNTED]]
    money = [part for name in SUMMED for part in money_merge(name)]
    return [*counts, *money, F.max("last_event_ts").alias("last_event_ts")]


def _finish(agg: DataFrame) -> DataFrame:
    """Aggregates with ``window_start``/``window_end`` -> the published feature row."""
    spend, buys, carts = money_total("spend"), F.col("purchase_count"), F.col("cart_count")
    return agg.select(
        "user_id",
        "window_start",
        "window_end",
        "event_count",
        *COUNTED,
        *[F.round(money_total(name), 2).alias(name) for name in SUMMED],
        F.when(buys > 0, F.round(spend / buys, 2)).alias("avg_order_value"),
        F.when(carts > 0, F.round(buys / carts, 4)).alias("cart_conversion"),
        *DISTINCT,
        F.unix_millis("last_event_ts").alias("last_event_ms"),
        F.unix_millis("window_end").alias("window_end_ms"),
    )


def windowed_features(
    events: DataFrame,
    window: str,
    slide: str,
    watermark: str = "2 minutes",
    exact: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """One row per (user, sliding window).

    ``strategy="direct"`` is Spark's own windowed aggregate: the only form a stream can use, and in
    batch the one with the same approximate distinct counts as the stream. It copies each event into
    window/slide rows before the map-side combine; a stream deals its events first to as many tasks as its
    session shuffles into, so that width bounds what a task combines. Sketches list the first values they see, so the
    state of a window grows with them, up to some 2 kB each.

    ``strategy="panes"`` (batch) combines events into panes first and shuffles panes, not windows, so the
    shuffles shrink with event density; a user who owns a third of all events still contributes at most
    one row per map task and pane (and pair of counted values, if exact). ``exact=True`` counts distincts
    exactly; otherwise mergeable sketches are kept per pane. It counts the events at once, to shuffle into as
    many tasks as their windows ask for, whatever the session's width.

    ``auto``: streams and approximate batch counts go direct (one answer for both), exact batch counts
    go through panes.
    """
    if events.isStreaming:
        if exact or strategy == "panes":
            raise ValueError("a stream supports approximate distinct counts with the direct strategy only")
        return _direct(events, window, slide, watermark, exact=False)
    if strategy == "auto":
        strategy = "panes" if exact else "direct"
    if strategy == "panes":
        return _paned(events, window, slide, exact)
    return _direct(events, window, slide, watermark, exact)


def _sketched(value: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(value, SKETCH_LG_K))


def _direct(events: DataFrame, window: str, slide: str, watermark: str, exact: bool) -> DataFrame:
    count = F.count_distinct if exact else _sketched
    if events.isStreaming:
        # a file may hold more events than one task should combine; times spread a hot user
        events = events.repartition("user_id", "event_ts")
    agg = (
        events.withWatermark("event_ts", watermark)
        .groupBy(F.window("event_ts", window, slide).alias("span"), "user_id")
        .agg(*_measures(), *[count(F.col(source)).alias(name) for name, source in DISTINCT.items()])
    )
    return _finish(agg.withColumns({"window_start": F.col("span.start"), "window_end": F.col("span.end")}))


def _parts(events: DataFrame, copies: int) -> int:
    """Tasks for the windows of as many events as there are, each in ``copies`` windows; counts them at once."""
    return tasks_for(events.sparkSession, events.count() * copies, ROWS)


def _paned(events: DataFrame, window: str, slide: str, exact: bool) -> DataFrame:
    length, step = to_micros(window), to_micros(slide)
    if step > length:
        raise ValueError("slide must not exceed the window")
    pane = gcd(length, step)  # every pane lies wholly inside or outside any window

    def aligned(at: Column, size: int) -> Column:
        return at - F.pmod(at, F.lit(size))

    def first_window(pane_at: Column) -> Column:
        return aligned(pane_at - F.lit(length), step) + F.lit(step)

    def last_window(pane_at: Column) -> Column:
        return aligned(pane_at, step)

    placed = events.where(F.col("event_ts").isNotNull()).withColumn(
        "pane", aligned(F.unix_micros("event_ts"), pane)
    )
    # Measures are combined map-side per pane; with exact counts, per pane and counted values. Panes then go to blocks
    # of window starts, a pane whose windows lie in two blocks to both, and all windows of a block are made where its
    # panes are: nothing is copied before the shuffle.
    values = list(DISTINCT.values())
    if exact:
        panes = placed.groupBy("user_id", "pane", *values).agg(*_measures())
    else:
        sketches = [F.hll_sketch_agg(F.col(source), SKETCH_LG_K).alias(name) for name, source in DISTINCT.items()]
        panes = placed.groupBy("user_id", "pane").agg(*_measures(), *sketches)
    size = F.lit(BLOCK * length)
    ends = F.array(*[F.floor(at / size).cast("bigint") for at in (first_window(F.col("pane")), last_window(F.col("pane")))])
    here = ["user_id", "block"]
    blocks = panes.withColumn("block", F.explode(F.array_distinct(ends))).repartition(_parts(events, -(-length // step)), *here)
    if exact:
        # A value is counted once per window it occurs in: a pane brings it only to the windows that the pane before with
        # this value did not reach already.
        reached = {
            f"_{name}": last_window(F.lag("pane").over(Window.partitionBy(*here, source).orderBy("pane")))
            for name, source in DISTINCT.items()
        }
        blocks = blocks.withColumns(reached)
        distinct = [
            F.count_if(F.col(source).isNotNull() & F.coalesce(F.col("start") > F.col(f"_{name}"), F.lit(True))).alias(name)
            for name, source in DISTINCT.items()
        ]
    else:
        distinct = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in DISTINCT]
    starts = F.sequence(first_window(F.col("pane")), last_window(F.col("pane")), F.lit(step).cast("bigint"))
    spread = blocks.withColumn("start", F.explode(starts)).where(F.floor(F.col("start") / size) == F.col("block"))
    agg = spread.groupBy(*here, "start").agg(*_merged_measures(), *distinct)
    return _finish(
        agg.withColumns(
            {
                "window_start": F.timestamp_micros("start"),
                "window_end": F.timestamp_micros(F.col("start") + F.lit(length)),
            }
        )
    )


def select_current_windows(windows: DataFrame, now: Column | None = None) -> DataFrame:
    """One window of each user, by a score of its end against ``now``.

    Ends that lie ahead score above all that have passed, and more the nearer they are; passed ends score
    their negative distance. ``max_by`` on the score combines map-side and sorts no user's windows.
    """
    now = F.current_timestamp() if now is None else now
    ahead = F.unix_micros("window_end") - F.unix_micros(now)
    top = F.lit(2**62)
    score = F.when(ahead > 0, top - ahead).otherwise(F.coalesce(ahead, -top))
    scored = windows.withColumn("_score", score)
    picks = [F.max_by(c, "_score").alias(c) for c in windows.columns if c != "user_id"]
    return scored.groupBy("user_id").agg(*picks).select(*windows.columns)
