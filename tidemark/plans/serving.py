"""Lookups of feature vectors and their latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import serving as ops
from tidemark.operators.profiles import latest_profile
from tidemark.plans import sql
from tidemark.plans.derived import AFTER_ALL, NOW, answered_lookups, at, events, plain, vectors
from tidemark.plans.store import VECTORS

REQUEST = ["u000003", "u999999", "u000001", "u000003", "u000014"]


def _lookup(spark, sf):
    return plain(ops.lookup(vectors(spark, sf), "u000007", at(AFTER_ALL)).drop("last_write"))


def _batch(spark, sf):
    found = ops.lookup_batch(latest_profile(events(spark, sf)), REQUEST, at(NOW))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def _request_table(spark, sf):
    return answered_lookups(spark, sf).select("pos", "user_id", "found", "last_seen_ms", "freshness_ms")


def _log(spark, sf):
    return ops.lookup_log(answered_lookups(spark, sf))


def _recent(spark, sf):
    return ops.newest(_log(spark, sf), "at", ops.RECENT_LOOKUPS, "latency_ms", "user_id")


QUERIES = {
    "lookup_user": _lookup,
    "lookup_batch": _batch,
    "lookup_request_table": _request_table,
    "lookup_log": lambda spark, sf: plain(_log(spark, sf)),
    "serving_recent": lambda spark, sf: plain(_recent(spark, sf)),
    "serving_latency_recent": lambda spark, sf: ops.serving_latency(_recent(spark, sf)),
    "latency_floor": lambda spark, sf: ops.serving_latency(answered_lookups(spark, sf)),
    "latency_round": lambda spark, sf: ops.benchmark_latency(answered_lookups(spark, sf)),
    "hit_rate": lambda spark, sf: ops.hit_rate(answered_lookups(spark, sf)),
    "sample_users": lambda spark, sf: ops.sample_users(latest_profile(events(spark, sf)), 8),
    "window_age": lambda spark, sf: ops.with_window_age(vectors(spark, sf), at(NOW)).select(
        "user_id", "window_age_ms_5m", "window_age_ms_1h"
    ),
    "vectors_as_of": lambda spark, sf: ops.as_of(vectors(spark, sf), at("2024-01-30 23:30:00")).select(
        "user_id", "event_count_5m", "event_count_1h", "spend_1h", "last_seen_ms"
    ),
}


def _ms(text: str) -> str:
    return f"epoch_us(timestamp '{text}') // 1000"


LOOKUPS = sql.PROFILE + f""",
lookups as (
  select o_orderkey as pos, 'u' || lpad(cast(o_custkey as varchar), 6, '0') as user_id, o_orderdate as "at",
         {sql.rounded("o_totalprice / 1000", 3)} as latency_ms
  from orders
),
answers as (
  select l.*, p.user_id is not null as found, last_seen_ms, {_ms(AFTER_ALL)} - last_seen_ms as freshness_ms
  from lookups l left join profile p using (user_id)
)"""

_RECENT = """,
recent as (
  select user_id, found, latency_ms, "at" from answers where found order by "at" desc, latency_ms, user_id limit 500
)"""


def _percentiles(source: str, count: str, places: int, **ranks: str) -> str:
    """Order statistics by position in the sorted values."""
    picks = ", ".join(f"{sql.rounded(f'max(case when i = {r} then v end)', places)} as {n}" for n, r in ranks.items())
    median = "(max(case when i = (n - 1) // 2 then v end) + max(case when i = n // 2 then v end)) / 2"
    return f"""
select coalesce(max(n), 0) as {count}, {sql.rounded(median, places)} as p50_ms, {picks} from (
  select latency_ms as v, row_number() over (order by latency_ms) - 1 as i, count(*) over () as n from {source})"""


_FLOOR = {"p95_ms": "least(n - 1, cast(floor(cast(0.95 as double) * n) as bigint))"}
_ROUND = {f"p{p}_ms": f"cast(round_even((n - 1) * {p} / 100, 0) as bigint)" for p in (95, 99)}

ORACLES = {
    "lookup_user": sql.with_(sql.EVENTS, VECTORS)
    + f"select * exclude (last_write), {_ms(AFTER_ALL)} - last_seen_ms as freshness_ms from vectors where user_id = 'u000007'",
    "lookup_batch": sql.with_(sql.EVENTS, sql.PROFILE) + f"""
select r.pos, r.user_id, p.user_id is not null as found, p.* exclude (user_id), {_ms(NOW)} - last_seen_ms as freshness_ms
from (select cast(generate_subscripts({REQUEST}, 1) - 1 as bigint) as pos, unnest({REQUEST}) as user_id) r
left join profile p using (user_id)""",
    "lookup_request_table": sql.with_(sql.EVENTS, LOOKUPS)
    + "select pos, user_id, found, last_seen_ms, freshness_ms from answers",
    "lookup_log": sql.with_(sql.EVENTS, LOOKUPS) + 'select user_id, found, latency_ms, "at" from answers where found',
    "serving_recent": sql.with_(sql.EVENTS, LOOKUPS + _RECENT) + "select * from recent",
    "serving_latency_recent": sql.with_(sql.EVENTS, LOOKUPS + _RECENT) + _percentiles("recent", "samples", 3, **_FLOOR),
    "latency_floor": sql.with_(sql.EVENTS, LOOKUPS) + _percentiles("answers", "samples", 3, **_FLOOR),
    "latency_round": sql.with_(sql.EVENTS, LOOKUPS) + _percentiles("answers", "lookups", 2, **_ROUND),
    "hit_rate": sql.with_(sql.EVENTS, LOOKUPS)
    + f"select count(*) as lookups, {sql.rounded('avg(cast(found as integer))', 3)} as hit_rate from answers",
    "sample_users": sql.with_(sql.EVENTS)
    + "select user_id from (select distinct user_id from ev) order by md5(user_id), user_id limit 8",
    "window_age": sql.with_(sql.EVENTS, VECTORS)
    + f"select user_id, {_ms(NOW)} - window_end_ms_5m as window_age_ms_5m, {_ms(NOW)} - window_end_ms_1h as window_age_ms_1h from vectors",
    "vectors_as_of": sql.with_(sql.EVENTS, VECTORS) + f"""
select user_id, case when window_end_ms_5m > t then event_count_5m end as event_count_5m,
       case when window_end_ms_1h > t then event_count_1h end as event_count_1h,
       case when window_end_ms_1h > t then spend_1h end as spend_1h, last_seen_ms
from (select *, {_ms("2024-01-30 23:30:00")} as t from vectors)""",
}
