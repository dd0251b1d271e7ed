"""Framed messages <-> typed events, with a reason for every message that is not an event."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.functions.avro import avro_decoder, avro_encoder
from tidemark.functions.once import computed_once
from tidemark.functions.records import Field, record_fields

CODECS = ("avro_arrow", "avro_jar", "json")


def split_frames(raw: DataFrame) -> DataFrame:
    """Add ``valid_magic, schema_id, payload`` to messages with a binary ``value``; without the magic byte
    the rest of the header means nothing and stays null."""
    value = F.col("value")
    magic = F.coalesce(wire.has_magic(value), F.lit(False))
    return raw.withColumns(
        {
            "valid_magic": magic,
            "schema_id": F.when(magic, wire.schema_id(value)),
            "payload": F.when(magic, wire.payload(value)),
        }
    )


def decode_messages(
    raw: DataFrame, writers: Mapping[int, str], reader: str, codec: str = "avro_arrow", required: str = "user_id"
) -> DataFrame:
    """All messages with ``schema_id``, the decoded struct ``e`` in reader shape, and ``reason``.

    ``reason`` is null for events; otherwise ``null_value``, ``bad_magic``, ``unknown_schema``,
    ``malformed`` or ``null_user``. Each message is decoded with the schema it was written with.
    """
    if not writers:
        raise ValueError("at least one writer schema is required")
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {CODECS}")
    fields = record_fields(reader)
    known = F.col("schema_id").isin(*sorted(writers))
    framed = split_frames(raw)
    body = F.when(known, F.col("payload"))
    if codec == "avro_arrow":
        stored = avro_decoder(writers, reader)(F.col("schema_id"), body)
    elif codec == "json":
        stored = _from_json(body, fields)
    else:
        stored = _from_avro(writers, reader)
    parsed = computed_once(framed, stored, "stored")

    def value_of(f: Field) -> Column:
        value = F.col(f"stored.`{f.name}`")
        return value if codec == "avro_jar" else f.to_logical(value)  # from_avro yields logical types

    empty = F.col("stored").isNull()
    if codec == "avro_jar":  # from_avro turns bytes it cannot read into a record of nulls
        empty = empty | reduce(and_, [F.col(f"stored.`{f.name}`").isNull() for f in fields])
    reason = (
        F.when(F.col("value").isNull(), "null_value")
        .when(~F.col("valid_magic"), "bad_magic")
        .when(F.col("payload").isNull(), "malformed")
        .when(F.col("schema_id").isNull() | ~known, "unknown_schema")
        .when(empty, "malformed")
        .when(F.col(f"stored.`{required}`").isNull(), "null_user")
    )
    values = [value_of(f).alias(f.name) for f in fields]
    return parsed.select(
        *raw.columns, "schema_id", F.when(~empty, F.struct(*values)).alias("e"), reason.alias("reason")
    )


def _from_json(body: Column, fields: list[Field]) -> Column:
    """JSON payloads; text that is not a record becomes null, absent fields take the reader's default."""
    ddl = ", ".join(f"`{f.name}` {f.physical}" for f in fields) + ", _bad string"
    parsed = F.from_json(body.cast("string"), ddl, {"columnNameOfCorruptRecord": "_bad"})
    values = []
    for f in fields:
        value = parsed[f.name]
        if f.has_default and f.default is not None:
            value = F.coalesce(value, F.lit(f.default).cast(f.physical))
        values.append(value.alias(f.name))
    return F.when(parsed["_bad"].isNull(), F.struct(*values))


def _from_avro(writers: Mapping[int, str], reader: str) -> Column:
    from pyspark.sql.avro.functions import from_avro

    options = {"mode": "PERMISSIVE", "avroSchema": reader}
    branches = [
        F.when(F.col("schema_id") == i, from_avro(F.col("payload"), schema, options)) for i, schema in writers.items()
    ]
    return F.coalesce(*branches)


def events_of(decoded: DataFrame) -> DataFrame:
    """The events among decoded messages, with the broker time as ``kafka_ts``."""
    return decoded.where(F.col("reason").isNull()).select("e.*", F.col("timestamp").alias("kafka_ts"))


def rejects_of(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNotNull()).drop("e")


def decode_events(raw: DataFrame, writers: Mapping[int, str], reader: str, codec: str = "avro_arrow") -> DataFrame:
    return events_of(decode_messages(raw, writers, reader, codec))


def decode_rejects(raw: DataFrame, writers: Mapping[int, str], reader: str, codec: str = "avro_arrow") -> DataFrame:
    return rejects_of(decode_messages(raw, writers, reader, codec))


def replayed(
    rejects: DataFrame, writers: Mapping[int, str], reader: str, codec: str = "avro_arrow", required: str = "user_id"
) -> DataFrame:
    """Kept rejects (``value, timestamp`` and any other columns) decoded again under newer contracts, as
    :func:`decode_messages` does it; ``rejected_for`` keeps what they were rejected for.

    ``events_of`` the result are the messages that were only ahead of their contract; ``rejects_of`` it stay rejects.
    """
    again = rejects.withColumnRenamed("reason", "rejected_for").drop("schema_id")
    return decode_messages(again, writers, reader, codec, required)


def encode_payload(schema: str, codec: str = "avro_arrow") -> Column:
    """Payload of the event columns under one schema."""
    fields = record_fields(schema)
    stored = F.struct(*[f.to_stored(F.col(f.name)).alias(f.name) for f in fields])
    if codec == "json":
        return F.to_json(stored).cast("binary")
    return avro_encoder(schema)(stored)


def encode_events(events: DataFrame, schemas: Mapping[int, str], schema_id: int, codec: str = "avro_arrow") -> DataFrame:
    """``key, value`` messages under a registered schema; an unregistered id fails before anything is written."""
    if schema_id not in schemas:
        raise ValueError(f"schema id {schema_id} is not registered")
    value = wire.frame(F.lit(schema_id), encode_payload(schemas[schema_id], codec))
    return events.select(F.col("user_id").cast("binary").alias("key"), value.alias("value"), "event_ts")
