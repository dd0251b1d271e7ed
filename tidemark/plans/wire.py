"""Framed messages, decoding, rejects, contract checks of records, dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators import validate
from tidemark.operators.decode import decode_messages, encode_payload, events_of, rejects_of, split_frames
from tidemark.operators.traffic import delivery_counters, delivery_rates
from tidemark.plans import sql
from tidemark.plans.derived import events, messages, plain, record_texts
from tidemark.sources.contracts import packaged_schemas


def _decoded(spark, sf, codec="json"):
    schemas = packaged_schemas()
    return decode_messages(messages(spark, sf, codec), schemas, schemas[max(schemas)], codec)


def _events(codec):
    return lambda spark, sf: plain(events_of(_decoded(spark, sf, codec)))


def _rejects(spark, sf):
    rows = rejects_of(_decoded(spark, sf))
    return plain(rows.select(F.col("key").cast("string").alias("event_id"), "reason", "schema_id", "timestamp"))


def _frames(spark, sf):
    rows = split_frames(messages(spark, sf, "json"))
    return rows.select(
        F.col("key").cast("string").alias("event_id"), "valid_magic", "schema_id",
        F.get_json_object(F.col("payload").cast("string"), "$.product_id").alias("product_id"),
    )


def _roundtrip(spark, sf):
    """Every event's id as schema id: framed, split, compared. Numbers beyond 32 bits go by their low four bytes."""
    ev = events(spark, sf).select(F.col("event_id").cast("bigint").alias("n"), F.col("user_id").cast("binary").alias("body"))
    spread = ev.withColumn("id", F.lit(2**31 - 1) - F.col("n") * 7919)
    framed = spread.withColumn("value", wire.frame(F.col("id"), F.col("body")))
    return split_frames(framed).select("n", F.col("schema_id"), F.col("payload").cast("string").alias("payload"))


def _payload_bytes(spark, sf):
    """Bytes of each record as its contract's JSON form."""
    schema = packaged_schemas()[2]
    return events(spark, sf).select("event_id", F.length(encode_payload(schema, "json")).alias("payload_bytes"))


def _checked(spark, sf):
    return validate.check_records(record_texts(spark, sf), packaged_schemas()[2])


def _letters(spark, sf):
    return validate.read_letters(validate.dead_letters(_checked(spark, sf)))


def _letter_report(spark, sf):
    report = validate.dead_letter_report(_letters(spark, sf), 8, "error")
    shown = F.transform("recent", lambda x: F.concat_ws(" @", x["error"], x["timestamp_ms"]))
    return report.select("total", F.array_join(shown, "; ").alias("newest"))


def _letter_rows(letters):
    event = F.when(F.col("event").startswith("{"), F.get_json_object("event", "$.event_id"))
    return plain(letters.select("key", "error", event.alias("event_id"), "timestamp"))


def _outcomes(spark, sf):
    """Delivery outcome of each record: dead letters do not reach the topic; unsent ones failed."""
    checked = _checked(spark, sf)
    product = F.try_variant_get(F.col("record"), "$.product_id", "string")
    failed = product == "p00083"
    outcome = F.when(F.size("errors") > 0, "dlq").when(failed, "failed").otherwise("delivered")
    return checked.select(outcome.alias("outcome"), "timestamp")


QUERIES = {
    "frame_split": _frames,
    "frame_roundtrip": _roundtrip,
    "payload_bytes": _payload_bytes,
    "decode_events": _events("json"),
    "decode_events_json": _events("json"),
    "decode_rejects": _rejects,
    "reject_reasons": lambda spark, sf: rejects_of(_decoded(spark, sf)).groupBy("reason").agg(
        F.count(F.lit(1)).alias("messages")
    ),
    "contract_split": lambda spark, sf: _checked(spark, sf).select(
        (F.size("errors") == 0).alias("valid")
    ).groupBy("valid").agg(F.count(F.lit(1)).alias("records")),
    "contract_valid_events": lambda spark, sf: plain(
        validate.valid_events(_checked(spark, sf), packaged_schemas()[2])
    ),
    "dead_letters": lambda spark, sf: _letter_rows(_letters(spark, sf)),
    "dead_letters_recent": lambda spark, sf: _letter_rows(validate.recent_letters(_letters(spark, sf), 8, "error")),
    "dead_letter_total": lambda spark, sf: _letters(spark, sf).agg(F.count(F.lit(1)).alias("total")),
    "dead_letter_report": _letter_report,
    "dead_letter_reasons": lambda spark, sf: validate.letter_reasons(_letters(spark, sf)),
    "delivery_counters": lambda spark, sf: delivery_counters(_outcomes(spark, sf)),
    "delivery_rates": lambda spark, sf: plain(delivery_rates(_outcomes(spark, sf), "1 hour", 3600)),
}

_REASON = """
reasons as (
  select *, case product_id when 'p00013' then 'bad_magic' when 'p00029' then 'unknown_schema'
                            when 'p00041' then 'malformed' when 'p00091' then 'malformed'
                            when 'p00057' then 'null_value' end as reason,
         case when device is null then 1 else 2 end as writer
  from ev
)"""
_DECODED = sql.with_(sql.EVENTS, _REASON) + """
select event_id, user_id, event_type, product_id, category, amount, currency, session_id, device,
       make_timestamp((epoch_us(event_ts) // 1000) * 1000) as event_ts, event_ts as kafka_ts
from reasons where reason is null"""

ERRORS = """
letters as (
  select event_id, event_ts as timestamp,
         case when product_id in ('p00013', 'p00029') then '' else user_id end as key,
         case product_id when 'p00013' then 'user_id: required field is missing'
                         when 'p00057' then 'amount: expected double (got STRING)'
                         when 'p00091' then 'event_ts: expected timestamp-millis (got STRING)'
                         when 'p00029' then 'record: not a JSON object' end as error,
         product_id
  from ev
)"""
_LETTERS = sql.with_(sql.EVENTS, ERRORS) + """
select key, error, case when product_id <> 'p00029' then event_id end as event_id, timestamp
from letters where error is not null"""
_OUTCOME = ERRORS + """,
outcomes as (
  select timestamp, case when error is not null then 'dlq' when product_id = 'p00083' then 'failed' else 'delivered' end as outcome
  from letters
)"""

ORACLES = {
    "frame_split": sql.with_(sql.EVENTS, _REASON) + """
select event_id, product_id not in ('p00013', 'p00057') as valid_magic,
       cast(case product_id when 'p00013' then null when 'p00057' then null when 'p00091' then null
                 when 'p00029' then 99 when 'p00041' then 2 else writer end as integer) as schema_id,
       case when product_id not in ('p00013', 'p00041', 'p00057', 'p00091') then product_id end as product_id
from reasons""",
    "frame_roundtrip": sql.with_(sql.EVENTS)
    + "select n, cast(2147483647 - n * 7919 as integer) as schema_id, user_id as payload from ev",
    "payload_bytes": sql.with_(sql.EVENTS) + """
select event_id, cast(strlen(
  '{"event_id":"' || event_id || '","user_id":"' || user_id || '","event_type":"' || event_type || '","product_id":"' || product_id
  || '","category":"' || category || '","amount":' || amount || ',"currency":"' || currency || '","event_ts":' || epoch_us(event_ts) // 1000
  || coalesce(',"device":"' || device || '"', '') || '}') as integer) as payload_bytes
from ev""",
    "decode_events": _DECODED,
    "decode_events_json": _DECODED,
    "decode_rejects": sql.with_(sql.EVENTS, _REASON) + """
select event_id, reason, event_ts as timestamp,
       cast(case reason when 'bad_magic' then null when 'unknown_schema' then 99 when 'null_value' then null
            else case product_id when 'p00041' then 2 end end as integer) as schema_id
from reasons where reason is not null""",
    "reject_reasons": sql.with_(sql.EVENTS, _REASON)
    + "select reason, count(*) as messages from reasons where reason is not null group by reason",
    "contract_split": sql.with_(sql.EVENTS, ERRORS)
    + "select error is null as valid, count(*) as records from letters group by 1",
    "contract_valid_events": sql.with_(sql.EVENTS) + """
select event_id, user_id, event_type, product_id, category, amount, currency, session_id, device,
       make_timestamp((epoch_us(event_ts) // 1000) * 1000) as event_ts
from ev where product_id not in ('p00013', 'p00029', 'p00057', 'p00091')""",
    "dead_letters": _LETTERS,
    "dead_letters_recent": _LETTERS + " order by timestamp desc, error limit 8",
    "dead_letter_total": sql.with_(sql.EVENTS, ERRORS) + "select count(error) as total from letters",
    "dead_letter_report": sql.with_(sql.EVENTS, ERRORS) + """
select (select count(error) from letters) as total,
       string_agg(error || ' @' || epoch_us(timestamp) // 1000, '; ' order by timestamp desc, error) as newest
from (select * from letters where error is not null order by timestamp desc, error limit 8)""",
    "dead_letter_reasons": sql.with_(sql.EVENTS, ERRORS) + """
select split_part(error, ' (', 1) as reason, count(*) as letters from letters where error is not null group by 1""",
    "delivery_counters": sql.with_(sql.EVENTS, _OUTCOME) + """
select count(*) filter (where outcome <> 'dlq') as sent, count(*) filter (where outcome = 'delivered') as delivered,
       count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'dlq') as dlq from outcomes""",
    "delivery_rates": sql.with_(sql.EVENTS, _OUTCOME) + f"""
select date_trunc('hour', timestamp) as interval_start, count(*) as delivered,
       {sql.rounded('count(*) / 3600', 3)} as per_second, {sql.rounded('count(*) / 3600 * 60', 3)} as per_minute
from outcomes where outcome = 'delivered' group by 1""",
}
