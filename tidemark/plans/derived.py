"""Frames that Spark derives from the given tables, so every registered query grows with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators.decode import encode_payload
from tidemark.operators.contracts import subject_name
from tidemark.operators.monitor import QUERY_NAMES
from tidemark.operators.profiles import latest_profile
from tidemark.operators.serving import lookup_batch
from tidemark.operators.store import feature_columns, fold_log, log_vectors, to_log
from tidemark.operators.windows import windowed_features
from tidemark.session import use_utc
from tidemark.sources.contracts import packaged_schemas
from tidemark.sources.storefront import padded_id, storefront

NOW = "2024-01-15 12:00:00"
AFTER_ALL = "2024-01-31 00:00:30"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storefront(table(spark, sf_dir, "events"))


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the given tables have them."""
    stamps = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df


# -- messages


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records as a producer hands them over; some products' records break the contract."""
    ev = events(spark, sf_dir)
    product = F.col("product_id")
    text = F.to_json(
        F.struct(
            "event_id",
            F.when(product != "p00013", F.col("user_id")).alias("user_id"),
            "event_type", "product_id", "category",
            F.when(product != "p00057", F.col("amount")).alias("amount"),
            "currency",
            F.unix_millis("event_ts").alias("event_ts"),
            "device",
        )
    )
    amount_text = F.regexp_replace(text, r'"category":"([^"]+)"', r'"category":"$1","amount":"12.99 USD"')
    text = (
        F.when(product == "p00057", amount_text)
        .when(product == "p00091", F.regexp_replace(text, r'"event_ts":[0-9]+', '"event_ts":"yesterday"'))
        .when(product == "p00029", F.substring(text, 1, 20))
        .otherwise(text)
    )
    return ev.select(text.alias("value"), F.col("event_ts").alias("timestamp"))


def messages(spark: SparkSession, sf_dir: str, codec: str = "avro_arrow") -> DataFrame:
    """A topic of framed events: no device means the first contract version, some products are damaged."""
    schemas = packaged_schemas()
    ev = events(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    version = F.when(F.col("device").isNull(), 1).otherwise(2)
    body = F.when(version == 1, encode_payload(schemas[1], codec)).otherwise(encode_payload(schemas[2], codec))
    product = F.col("product_id")
    value = (
        F.when(product == "p00013", F.concat(F.lit(b"\x01"), F.col("body")))
        .when(product == "p00029", wire.frame(F.lit(99), F.col("body")))
        .when(product == "p00041", wire.frame(F.lit(2), F.substring(F.col("body"), 1, 3)))
        .when(product == "p00091", F.substring(F.lit(b"\x00\x00\x00"), 1, 3))
        .when(product != "p00057", wire.frame(version, F.col("body")))
    )
    return ev.withColumn("body", body).select(
        F.col("event_id").cast("binary").alias("key"),
        value.alias("value"),
        F.pmod(number, F.lit(6)).cast("int").alias("partition"),
        F.floor(number / 6).alias("offset"),
        F.col("event_ts").alias("timestamp"),
    )


# -- contracts


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with one subject per customer and one version per order; a few texts do not parse."""
    orders = table(spark, sf_dir, "orders")
    urgent = F.substring("o_orderpriority", 1, 1)
    stamp = F.when(urgent < "3", '{"type":"long","logicalType":"timestamp-millis"}').otherwise(
        '{"logicalType": "timestamp-millis", "type": "long"}'
    )
    fields = F.concat_ws(
        ",",
        F.lit('{"name":"user_id","type":"string"}'),
        F.when(F.col("o_orderstatus") == "P", '{"name":"amount","type":"string"}').otherwise(
            '{"name":"amount","type":"double"}'
        ),
        F.concat(F.lit('{"name":"event_ts","type":'), stamp, F.lit("}")),
        F.when(urgent < "3", '{"name":"device","type":["null","string"],"default":null}'),
        F.when(F.col("o_totalprice") > 250000, '{"name":"voucher","type":"string"}'),
        F.when(F.dayofmonth("o_orderdate") > 15, '{"name":"currency","type":"string","default":"USD"}'),
    )
    schema = F.concat(
        F.lit('{"type":"record","name":"Order","doc":"'), F.col("o_orderpriority"), F.lit('","fields":['), fields, F.lit("]}")
    )
    return orders.select(
        subject_name(padded_id("c", F.col("o_custkey"), 6)).alias("subject"),
        F.col("o_orderkey").cast("int").alias("version"),
        (F.col("o_orderkey") + 1).cast("int").alias("schema_id"),
        F.when(F.col("o_totalprice") < 5000, '{"broken').otherwise(schema).alias("schema"),
    )


# -- store


def guarded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose guards often run backwards, with nulls among the guards and fields."""
    number = F.col("event_id").cast("bigint")
    guard = F.pmod(number * 7919, F.lit(10007)) + number * 3
    return events(spark, sf_dir).select(
        "user_id",
        F.lit("profile").alias("grp"),
        number.alias("seq"),
        F.when(F.col("event_type") != "signup", guard).alias("guard"),
        F.col("event_ts").alias("write_ts"),
        F.col("device").alias("last_device"),
        F.col("category").alias("last_category"),
        F.when(F.col("event_type") == "purchase", F.col("amount")).alias("spend"),
    )


def expiring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same writes dealt to two groups, whose users are often silent for longer than a day."""
    return guarded_log(spark, sf_dir).withColumn("grp", F.when(F.col("seq") % 2 == 0, "profile").otherwise("5m"))


def window_log(spark: SparkSession, sf_dir: str, grp: str, window: str, slide: str, slide_s: int) -> DataFrame:
    """Every window of every user as a log row, written when it ends; every eleventh one three slides late."""
    feats = windowed_features(events(spark, sf_dir), window, slide, exact=True)
    number = F.expr(f"window_end_ms div {slide_s * 1000}")
    seq = number * 2 + F.when(number % 11 == 0, 7).otherwise(0)
    return to_log(feats.drop("window_start", "window_end"), grp, seq, "window_end_ms", F.timestamp_millis("window_end_ms"))


def profile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_profile(events(spark, sf_dir))
    return to_log(rows, "profile", F.lit(0), "last_seen_ms", F.timestamp_millis("last_seen_ms"))


def folds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three feature groups folded."""
    return {
        "5m": fold_log(window_log(spark, sf_dir, "5m", "5 minutes", "1 minute", 60)),
        "1h": fold_log(window_log(spark, sf_dir, "1h", "1 hour", "10 minutes", 600)),
        "profile": fold_log(profile_log(spark, sf_dir)),
    }


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from one fold over the log of all groups."""
    logs = {
        "5m": window_log(spark, sf_dir, "5m", "5 minutes", "1 minute", 60),
        "1h": window_log(spark, sf_dir, "1h", "1 hour", "10 minutes", 600),
        "profile": profile_log(spark, sf_dir),
    }
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs.values())
    return log_vectors(union, {g: feature_columns(log) for g, log in logs.items()})


# -- lookups


def answered_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a lookup of its customer's vector; latency follows the price."""
    orders = table(spark, sf_dir, "orders")
    request = orders.select(
        F.col("o_orderkey").alias("pos"),
        padded_id("u", F.col("o_custkey"), 6).alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.round(F.col("o_totalprice") / 1000, 3).alias("latency_ms"),
    )
    profiles = latest_profile(events(spark, sf_dir))
    return lookup_batch(profiles, request, at(AFTER_ALL))


# -- progress


def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly micro-batches of the three queries, as the JSON text a streaming query reports."""
    raw = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    hourly = raw.groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(F.col("event_type") != "error").alias("some_rows"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("worth"),
        F.count_if(F.col("value") > 20).alias("users"),
    )
    named = hourly.select("*", F.explode(F.array(*map(F.lit, QUERY_NAMES))).alias("name"))
    rows = F.when(F.col("name") == "window_1h", F.col("some_rows")).otherwise(F.col("all_rows"))
    ended = F.date_format(F.col("hour") + F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    operators = F.array(
        F.struct(F.col("users").alias("numRowsTotal")), F.struct(F.col("all_rows").alias("numRowsTotal"))
    )
    report = F.struct(
        "name",
        F.floor(F.unix_seconds("hour") / 3600).alias("batchId"),
        ended.alias("timestamp"),
        rows.alias("numInputRows"),
        (rows / 36).alias("inputRowsPerSecond"),
        F.when(F.col("name") != "window_5m", F.col("worth") / 100).otherwise(rows / 30).alias("processedRowsPerSecond"),
        F.struct((F.col("all_rows") * 7).alias("triggerExecution")).alias("durationMs"),
        F.when(F.col("name") != "profile", operators).alias("stateOperators"),
    )
    return named.select(F.to_json(report).alias("json"))
