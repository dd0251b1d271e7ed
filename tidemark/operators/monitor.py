"""Progress of the streaming queries: flattening, health, capacity and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The queries the job runs, limits and labels of the reports.
QUERY_NAMES = ["window_5m", "window_1h", "profile"]
STALE_MS = 60_000
BUSY_ABOVE = 0.9
CAPACITY_CAP = 1.5
RAW_CHARS = 20_000
HISTORY_POINTS = 100
HISTORY_MINUTES = 5

_PROGRESS = """
    name string, batchId bigint, timestamp string, numInputRows bigint,
    inputRowsPerSecond double, processedRowsPerSecond double,
    durationMs struct<triggerExecution: bigint>,
    stateOperators array<struct<numRowsTotal: bigint>>
"""


def flatten_progress(reports: DataFrame) -> DataFrame:
    """Progress reports as JSON text (column ``json``) -> one typed row per (query, batch)."""
    p = F.from_json("json", _PROGRESS)
    rows = reports.withColumn("p", p)
    states = F.transform("p.stateOperators", lambda op: F.coalesce(op["numRowsTotal"], F.lit(0).cast("bigint")))
    total = F.aggregate(states, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return rows.select(
        F.col("p.name").alias("query"),
        F.coalesce("p.batchId", F.lit(-1)).alias("batch_id"),
        F.coalesce("p.timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("p.numInputRows", F.lit(0)).alias("num_input_rows"),
        F.round(F.coalesce(F.nanvl("p.inputRowsPerSecond", F.lit(0.0)), F.lit(0.0)), 2).alias("input_rows_per_second"),
        F.round(F.coalesce(F.nanvl("p.processedRowsPerSecond", F.lit(0.0)), F.lit(0.0)), 2).alias(
            "processed_rows_per_second"
        ),
        F.coalesce("p.durationMs.triggerExecution", F.lit(0)).alias("trigger_execution_ms"),
        F.coalesce(total, F.lit(0)).alias("state_rows"),
        F.col("json").alias("raw"),
    )


def shown_progress(progress: DataFrame) -> DataFrame:
    """Progress rows as reports show them: the stored report is whole, the shown one is cut."""
    return progress.withColumn("raw", F.substring("raw", 1, RAW_CHARS))


def latest_progress(progress: DataFrame) -> DataFrame:
    """The newest row of each query."""
    rest = [c for c in progress.columns if c != "query"]
    return (
        progress.groupBy("query").agg(F.max_by(F.struct(*rest), "batch_id").alias("last")).select("query", "last.*")
    )


def _all_queries(latest: DataFrame) -> DataFrame:
    """Exactly the known queries; those that have not reported have null columns."""
    names = latest.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, QUERY_NAMES))).alias("query"))
    return names.join(latest.withColumn("reporting", F.lit(True)), "query", "left")


def with_age(latest: DataFrame, now: Column) -> DataFrame:
    """``batch_age_ms``: time since the last batch, never negative, null without a readable time."""
    at = F.try_to_timestamp(F.col("timestamp"))
    age = F.when(at.isNotNull(), F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(at)))
    return latest.withColumn("batch_age_ms", age)


def batch_ages(latest: DataFrame, now: Column) -> DataFrame:
    return with_age(_all_queries(latest), now).select("query", "batch_age_ms")


def health(latest: DataFrame, now: Column) -> DataFrame:
    """One row: ``starting``, ``stalled`` or ``live``, with how many queries report and how old they are."""
    oldest, reporting = F.col("oldest_ms"), F.col("reporting")
    seconds = lambda ms: F.floor(ms / 1000 + F.lit(0.5)).cast("string")
    ages = batch_ages(latest, now).agg(
        F.max("batch_age_ms").alias("oldest_ms"),
        F.min("batch_age_ms").alias("newest_ms"),
        F.count("batch_age_ms").alias("reporting"),
    )
    stalled = oldest > STALE_MS
    return ages.select(
        F.when(reporting == 0, "starting").when(stalled, "stalled").otherwise("live").alias("state"),
        F.when(reporting == 0, "waiting for the first batch")
        .when(stalled, F.concat(F.lit("no new batches for "), seconds(oldest), F.lit(" s")))
        .otherwise(
            F.concat(
                reporting.cast("string"), F.lit(f" of {len(QUERY_NAMES)} queries reporting, last batch "),
                seconds(F.col("newest_ms")), F.lit(" s ago"),
            )
        )
        .alias("detail"),
        "reporting",
        "oldest_ms",
        "newest_ms",
    )


def capacity(latest: DataFrame) -> DataFrame:
    """Share of processing capacity in use per query (null when nothing was processed) and its label."""
    rate = F.col("input_rows_per_second") / F.col("processed_rows_per_second")
    used = F.when(F.col("processed_rows_per_second") > 0, F.least(F.lit(CAPACITY_CAP), rate))
    label = (
        F.when(F.col("reporting").isNull(), "Starting")
        .when(F.col("utilization") > BUSY_ABOVE, "Busy")
        .otherwise("Healthy")
    )
    return _all_queries(latest).withColumn("utilization", used).select("query", "utilization", label.alias("status"))


def kpi_report(latest: DataFrame, now: Column) -> DataFrame:
    """Queries reporting, and good only if all report and none is stale."""
    rows = with_age(_all_queries(latest), now)
    known = F.count("reporting")
    stale = F.count_if(F.col("batch_age_ms") > STALE_MS)
    return rows.agg(
        known.alias("reporting"),
        F.count(F.lit(1)).alias("queries"),
        stale.alias("stale"),
        ((known == len(QUERY_NAMES)) & (stale == 0)).alias("good"),
    )


def events_per_minute(rate_per_second: Column) -> Column:
    return F.bround(F.coalesce(rate_per_second, F.lit(0.0)) * 60).cast("bigint")


_REPORTED = [
    "batch_id", "timestamp", "num_input_rows", "input_rows_per_second",
    "processed_rows_per_second", "trigger_execution_ms", "state_rows",
]


def stats_report(latest: DataFrame, store_keys: DataFrame, serving: DataFrame, now: Column) -> DataFrame:
    """One row: store size, events per minute, the metrics of every query, serving latency, server time.

    The three inputs are a row per query, one row ``users`` and one row ``samples, p50_ms, p95_ms``;
    they are stacked and aggregated, not cross joined.
    """
    stacked = latest.unionByName(store_keys, allowMissingColumns=True).unionByName(serving, allowMissingColumns=True)
    of = lambda query, name: F.max(F.when(F.col("query") == query, F.col(name)))
    per_query = [of(q, name).alias(f"{q}_{name}") for q in QUERY_NAMES for name in _REPORTED]
    return stacked.agg(
        F.max("users").alias("online_store_keys"),
        events_per_minute(of("profile", "input_rows_per_second")).alias("events_per_minute"),
        *per_query,
        F.max("samples").alias("samples"),
        F.max("p50_ms").alias("p50_ms"),
        F.max("p95_ms").alias("p95_ms"),
        F.unix_millis(F.max(now)).alias("server_time_ms"),
    )


def throughput_report(latest: DataFrame, ingest: DataFrame, store_keys: DataFrame, hits: DataFrame,
                      latency: DataFrame) -> DataFrame:
    """One row: ingest rate, rates and trigger time per query, store size, hit rate and percentiles."""
    stacked = latest
    for part in (ingest, store_keys, hits.select("hit_rate"), latency):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    rates = ["input_rows_per_second", "processed_rows_per_second", "trigger_execution_ms"]
    of = lambda query, name: F.max(F.when(F.col("query") == query, F.col(name)))
    return stacked.agg(
        F.max("events_per_minute").alias("ingest_events_per_minute"),
        *[of(q, name).alias(f"{q}_{name}") for q in QUERY_NAMES for name in rates],
        F.max("users").alias("online_store_keys"),
        *[F.max(name).alias(name) for name in ("lookups", "hit_rate", "p50_ms", "p95_ms", "p99_ms")],
    )


def throughput_samples(progress: DataFrame, query: str = "profile") -> DataFrame:
    """``at, events_per_minute`` from the progress of the query that counts events once."""
    return progress.where(F.col("query") == query).select(
        F.try_to_timestamp(F.col("timestamp")).alias("at"),
        events_per_minute(F.col("input_rows_per_second")).alias("events_per_minute"),
    ).where(F.col("at").isNotNull())


def recent_throughput(samples: DataFrame, now: Column) -> DataFrame:
    """The chart's points: at most the last 100 samples, of those the ones of the last 5 minutes."""
    last = samples.where(F.col("at") <= now).orderBy(F.col("at").desc()).limit(HISTORY_POINTS)
    return last.where(F.unix_millis(now) - F.unix_millis("at") <= HISTORY_MINUTES * 60_000)


def throughput_history(samples: DataFrame) -> DataFrame:
    """Each sample time with the peak of the five minutes up to it.

    A window over the whole time axis would run in one task. Samples are combined per time, copied into
    their own five-minute block and the next one, and windowed per block: the look-back of a sample never
    leaves these two blocks, and a block holds at most one row per millisecond.
    """
    block = HISTORY_MINUTES * 60_000
    per_time = samples.groupBy(F.unix_millis("at").alias("ms")).agg(
        F.max("events_per_minute").alias("events_per_minute")
    )
    own = F.col("ms") - F.pmod("ms", F.lit(block))
    copies = per_time.select(
        "ms", "events_per_minute", own.alias("own"),
        F.explode(F.array(own, own + F.lit(block))).alias("block"),
    )
    back = Window.partitionBy("block").orderBy("ms").rangeBetween(-block, 0)
    return (
        copies.withColumn("peak", F.max("events_per_minute").over(back))
        .where(F.col("own") == F.col("block"))
        .select(F.timestamp_millis("ms").alias("at"), "events_per_minute", "peak")
    )


def peak_throughput(samples: DataFrame) -> DataFrame:
    """The greatest rate among the samples (0 without any) and how many there are."""
    return samples.agg(
        F.coalesce(F.max("events_per_minute"), F.lit(0)).alias("peak"), F.count(F.lit(1)).alias("samples")
    )
