"""Progress tables, health, capacity, reports, traffic counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import monitor as ops
from tidemark.operators import serving, store, traffic
from tidemark.operators.profiles import latest_profile
from tidemark.plans import sql
from tidemark.plans.derived import AFTER_ALL, answered_lookups, at, events, messages, plain, profile_log, progress_reports
from tidemark.plans.serving import LOOKUPS

STALLED_AT = "2024-01-31 00:05:00"
BEFORE_ALL, EARLY = "2024-01-01 00:30:00", "2024-01-01 05:00:20"


def _progress(spark, sf):
    return ops.flatten_progress(progress_reports(spark, sf))


def _latest(spark, sf):
    return ops.latest_progress(_progress(spark, sf).drop("raw"))


def _latest_until(spark, sf, text):
    """The newest reports of batches that had ended by then."""
    rows = _progress(spark, sf).drop("raw").where(F.try_to_timestamp("timestamp") <= at(text))
    return ops.latest_progress(rows)


def _samples(spark, sf):
    return ops.throughput_samples(_progress(spark, sf))


def _store_keys(spark, sf):
    return store.store_size(store.fold_log(profile_log(spark, sf), parts=None))


def _stats(spark, sf):
    latency = serving.serving_latency(serving.newest(
        serving.lookup_log(answered_lookups(spark, sf)), "at", serving.RECENT_LOOKUPS, "latency_ms", "user_id"))
    return ops.stats_report(_latest(spark, sf), _store_keys(spark, sf), latency, at(AFTER_ALL))


def _throughput(spark, sf):
    answers = answered_lookups(spark, sf)
    return ops.throughput_report(
        _latest(spark, sf), traffic.ingest_rate(_topic(spark, sf)), _store_keys(spark, sf),
        serving.hit_rate(answers), serving.benchmark_latency(answers),
    )


def _topic(spark, sf):
    """Position and time of the messages; their bytes are not built."""
    return messages(spark, sf, "json").select("partition", "offset", "timestamp")


QUERIES = {
    "progress_rows": lambda spark, sf: _progress(spark, sf).drop("raw"),
    "progress_raw": lambda spark, sf: _progress(spark, sf).groupBy("query").agg(
        F.count_if(F.get_json_object("raw", "$.batchId").cast("bigint") == F.col("batch_id")).alias("readable")
    ),
    "latest_progress": _latest,
    "batch_ages": lambda spark, sf: ops.batch_ages(_latest(spark, sf), at(AFTER_ALL)),
    "health_live": lambda spark, sf: ops.health(_latest(spark, sf), at(AFTER_ALL)),
    "health_stalled": lambda spark, sf: ops.health(_latest(spark, sf), at(STALLED_AT)),
    "health_starting": lambda spark, sf: ops.health(_latest_until(spark, sf, BEFORE_ALL), at(BEFORE_ALL)),
    "health_early": lambda spark, sf: ops.health(_latest_until(spark, sf, EARLY), at(EARLY)),
    "capacity": lambda spark, sf: ops.capacity(_latest(spark, sf)),
    "kpi_report": lambda spark, sf: ops.kpi_report(_latest(spark, sf), at(AFTER_ALL)),
    "stats_report": _stats,
    "throughput_report": _throughput,
    "throughput_history": lambda spark, sf: plain(ops.throughput_history(_message_rates(spark, sf))),
    "recent_throughput": lambda spark, sf: plain(ops.recent_throughput(_message_rates(spark, sf), at("2024-01-30 23:59:00"))),
    "peak_throughput": lambda spark, sf: ops.peak_throughput(_samples(spark, sf)),
    "topic_size": lambda spark, sf: traffic.topic_size(_topic(spark, sf)),
    "ingest_rate": lambda spark, sf: traffic.ingest_rate(_topic(spark, sf)),
    "ingest_per_minute": lambda spark, sf: plain(traffic.ingest_per_minute(_topic(spark, sf))),
    "event_mix": lambda spark, sf: traffic.event_mix(events(spark, sf)),
    "top_user_share": lambda spark, sf: traffic.top_user_share(events(spark, sf)),
    "user_freshness": lambda spark, sf: latest_profile(events(spark, sf)).select(
        "user_id", (F.unix_millis(at(AFTER_ALL)) - F.col("last_seen_ms")).alias("freshness_ms")
    ),
}


def _message_rates(spark, sf):
    """Throughput samples as they arrive: one per event, its rate the event's value."""
    ev = events(spark, sf)
    return ev.select(F.col("event_ts").alias("at"), F.bround(F.col("amount") * 60).cast("bigint").alias("events_per_minute"))


PROGRESS = f"""
hours as (
  select date_trunc('hour', ts) as hour, count(*) as n, count(*) filter (where event_type <> 'error') as n_some,
         cast(sum(cast(value as decimal(18,4))) as double) as worth, count(*) filter (where value > 20) as users
  from events group by 1
),
progress as (
  select q as query, epoch_us(hour) // 3600000000 as batch_id,
         strftime(hour + interval 1 hour, '%Y-%m-%dT%H:%M:%S.000Z') as timestamp, hour + interval 1 hour as ended,
         n_rows as num_input_rows, {sql.rounded('n_rows / 36', 2)} as input_rows_per_second,
         {sql.rounded("case when q = 'window_5m' then n_rows / 30 else worth / 100 end", 2)} as processed_rows_per_second,
         n * 7 as trigger_execution_ms, case when q = 'profile' then 0 else users + n end as state_rows
  from (select *, case q when 'window_1h' then n_some else n end as n_rows
        from hours, (select unnest(['window_5m', 'window_1h', 'profile']) as q))
),
latest as (
  select * from progress qualify row_number() over (partition by query order by batch_id desc) = 1
)"""


def _health_sql(now: str) -> str:
    return sql.with_(PROGRESS) + f"""
select case when oldest_ms > 60000 then 'stalled' else 'live' end as state,
       case when oldest_ms > 60000 then 'no new batches for ' || cast(floor(oldest_ms / 1000 + 0.5) as bigint) || ' s'
            else reporting || ' of 3 queries reporting, last batch ' || cast(floor(newest_ms / 1000 + 0.5) as bigint) || ' s ago'
       end as detail, reporting, oldest_ms, newest_ms
from (select count(*) as reporting, max(age) as oldest_ms, min(age) as newest_ms
      from (select greatest(0, epoch_ms(timestamp '{now}') - epoch_ms(ended)) as age from latest))"""


_QUERIES = ("window_5m", "window_1h", "profile")
_REPORTED = (
    "batch_id", "timestamp", "num_input_rows", "input_rows_per_second", "processed_rows_per_second",
    "trigger_execution_ms", "state_rows",
)


def _per_query(names) -> str:
    return ", ".join(
        f"(select {n} from latest where query = '{q}') as {q}_{n}" for q in _QUERIES for n in names
    )


_RATES = """
rates as (select ts as "at", cast(round_even(value * 60, 0) as bigint) as events_per_minute from events)"""
_INGEST = """
ends as (
  select event_id % 6 as part, max(event_id // 6) - min(event_id // 6) as grown, max(event_id // 6) + 1 as end_offset,
         min(ts) as since, max(ts) as until from events group by 1
),
ingest as (
  select cast(sum(grown) as bigint) as produced,
         cast(round_even(sum(grown) / ((epoch_us(max(until)) - epoch_us(min(since))) / 1e6) * 60, 0) as bigint) as events_per_minute
  from ends
)"""
_SORTED = """,
s as (select latency_ms as v, row_number() over (order by latency_ms) - 1 as i, count(*) over () as n from {source})"""


def _stat(rank: str, places: int) -> str:
    return f"(select {sql.rounded(f'max(case when i = {rank} then v end)', places)} from s)"


def _median(places: int) -> str:
    mid = "(max(case when i = (n - 1) // 2 then v end) + max(case when i = n // 2 then v end)) / 2"
    return f"(select {sql.rounded(mid, places)} from s)"


def _health_until(now: str) -> str:
    """Health from the batches that had ended by then; none of them: starting."""
    until = PROGRESS.replace("select * from progress qualify", f"select * from progress where ended <= timestamp '{now}' qualify")
    known = _health_sql(now).replace(sql.with_(PROGRESS), "")
    return sql.with_(until) + f"""
select if(reporting = 0, 'starting', state) as state, if(reporting = 0, 'waiting for the first batch', detail) as detail,
       reporting, oldest_ms, newest_ms from ({known})"""


ORACLES = {
    "progress_rows": sql.with_(PROGRESS) + "select * exclude (ended) from progress",
    "progress_raw": sql.with_(PROGRESS) + "select query, count(*) as readable from progress group by query",
    "latest_progress": sql.with_(PROGRESS) + "select * exclude (ended) from latest",
    "batch_ages": sql.with_(PROGRESS)
    + f"select query, greatest(0, epoch_ms(timestamp '{AFTER_ALL}') - epoch_ms(ended)) as batch_age_ms from latest",
    "health_live": _health_sql(AFTER_ALL),
    "health_stalled": _health_sql(STALLED_AT),
    "health_starting": _health_until(BEFORE_ALL),
    "health_early": _health_until(EARLY),
    "capacity": sql.with_(PROGRESS) + """
select query, least(1.5, input_rows_per_second / processed_rows_per_second) as utilization,
       case when input_rows_per_second / processed_rows_per_second > 0.9 then 'Busy' else 'Healthy' end as status
from latest""",
    "kpi_report": sql.with_(PROGRESS) + f"""
select count(*) as reporting, cast(3 as bigint) as queries, count(*) filter (where age > 60000) as stale,
       count(*) = 3 and count(*) filter (where age > 60000) = 0 as good
from (select epoch_ms(timestamp '{AFTER_ALL}') - epoch_ms(ended) as age from latest)""",
    "stats_report": sql.with_(sql.EVENTS, PROGRESS, LOOKUPS + """,
recent as (select latency_ms from answers where found order by "at" desc, latency_ms, user_id limit 500)"""
                              + _SORTED.format(source="recent")) + f"""
select (select count(distinct user_id) from ev) as online_store_keys,
       (select cast(round_even(input_rows_per_second * 60, 0) as bigint) from latest where query = 'profile') as events_per_minute,
       {_per_query(_REPORTED)},
       (select count(*) from s) as samples, {_median(3)} as p50_ms,
       {_stat("least(n - 1, cast(floor(cast(0.95 as double) * n) as bigint))", 3)} as p95_ms,
       epoch_ms(timestamp '{AFTER_ALL}') as server_time_ms""",
    "throughput_report": sql.with_(sql.EVENTS, PROGRESS, _INGEST, LOOKUPS + _SORTED.format(source="answers")) + f"""
select (select events_per_minute from ingest) as ingest_events_per_minute,
       {_per_query(("input_rows_per_second", "processed_rows_per_second", "trigger_execution_ms"))},
       (select count(distinct user_id) from ev) as online_store_keys,
       (select count(*) from answers) as lookups,
       (select {sql.rounded("avg(cast(found as integer))", 3)} from answers) as hit_rate,
       {_median(2)} as p50_ms, {_stat("cast(round_even((n - 1) * 95 / 100, 0) as bigint)", 2)} as p95_ms,
       {_stat("cast(round_even((n - 1) * 99 / 100, 0) as bigint)", 2)} as p99_ms""",
    "throughput_history": sql.with_(_RATES) + """
select make_timestamp(ms * 1000) as "at", events_per_minute,
       max(events_per_minute) over (order by ms range between 300000 preceding and current row) as peak
from (select epoch_us("at") // 1000 as ms, max(events_per_minute) as events_per_minute from rates group by 1)""",
    "recent_throughput": sql.with_(_RATES) + """
select * from (select * from rates where "at" <= timestamp '2024-01-30 23:59:00' order by "at" desc limit 100)
where epoch_us(timestamp '2024-01-30 23:59:00') // 1000 - epoch_us("at") // 1000 <= 300000""",
    "peak_throughput": sql.with_(PROGRESS) + """
select max(cast(round_even(input_rows_per_second * 60, 0) as bigint)) as peak, count(*) as samples
from progress where query = 'profile'""",
    "topic_size": sql.with_(_INGEST) + "select count(*) as partitions, cast(sum(end_offset) as bigint) as messages from ends",
    "ingest_rate": sql.with_(_INGEST) + "select * from ingest",
    "ingest_per_minute": "select date_trunc('minute', ts) as minute, count(*) as messages from events group by 1",
    "event_mix": sql.with_(sql.EVENTS) + f"""
select event_type, count(*) as events, {sql.rounded("count(*) / (select count(*) from ev)", 6)} as share
from ev group by event_type""",
    "top_user_share": sql.with_(sql.EVENTS) + f"""
select count(*) as users, max(k) as top_users, cast(sum(n) as bigint) as events,
       {sql.rounded("sum(n) filter (where rn <= k) / sum(n)", 6)} as top_share
from (select count(*) as n, row_number() over (order by count(*) desc) as rn,
             cast(ceil(count(*) over () * cast(0.1 as double)) as bigint) as k from ev group by user_id)""",
    "user_freshness": sql.with_(sql.EVENTS, sql.PROFILE)
    + f"select user_id, epoch_ms(timestamp '{AFTER_ALL}') - last_seen_ms as freshness_ms from profile",
}
