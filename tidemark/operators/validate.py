"""JSON records checked against a contract before they are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.once import computed_once
from tidemark.functions.records import Field, record_fields

# VARIANT types that a field of each primitive accepts (an integer is a fine double).
_NUMBERS = ["BIGINT", "DECIMAL", "FLOAT", "DOUBLE"]
_ACCEPTED = {
    "string": ["STRING"],
    "bytes": ["STRING", "BINARY"],
    "boolean": ["BOOLEAN"],
    "int": ["BIGINT"],
    "long": ["BIGINT"],
    "float": _NUMBERS,
    "double": _NUMBERS,
}


def _field_check(record: Column, field: Field) -> Column:
    """What the contract wants of a field beside the type it has: null when absent, VOID when null."""
    accepted = _ACCEPTED[field.primitive] + (["VOID"] if field.nullable else [])
    kind = F.schema_of_variant(F.try_variant_get(record, f"$['{field.name}']", "variant"))
    return F.struct(
        F.lit(field.name).alias("name"),
        F.lit(field.logical or field.primitive).alias("wanted"),
        F.array(*map(F.lit, accepted)).alias("accepted"),
        F.lit(not field.has_default).alias("required"),
        F.substring_index(kind, "(", 1).alias("kind"),
    )


def _message(check: Column) -> Column:
    missing = F.when(check["required"], F.concat(check["name"], F.lit(": required field is missing")))
    wrong = F.concat(check["name"], F.lit(": expected "), check["wanted"], F.lit(" (got "), check["kind"], F.lit(")"))
    return F.when(check["kind"].isNull(), missing).when(~F.array_contains(check["accepted"], check["kind"]), wrong)


def contract_errors(record: Column, schema: str) -> Column:
    """Array of messages, one per field that breaks the contract; fields the contract lacks are ignored."""
    checks = F.array(*[_field_check(record, f) for f in record_fields(schema)])
    errors = F.filter(F.transform(checks, _message), lambda e: e.isNotNull())
    not_record = F.array(F.lit("record: not a JSON object"))
    return F.when(record.isNull() | ~F.schema_of_variant(record).startswith("OBJECT"), not_record).otherwise(errors)


def check_records(records: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Add ``record`` (VARIANT) and ``errors`` to JSON text."""
    parsed = computed_once(records, F.try_parse_json(F.col(column).cast("string")), "record")
    return parsed.withColumn("errors", contract_errors(F.col("record"), schema))


def valid_events(checked: DataFrame, schema: str) -> DataFrame:
    """Typed events of the records without errors; absent optional fields take their default."""
    columns = []
    for f in record_fields(schema):
        value = F.try_variant_get(F.col("record"), f"$['{f.name}']", f.physical)
        if f.has_default and f.default is not None:
            value = F.coalesce(value, F.lit(f.default).cast(f.physical))
        columns.append(f.to_logical(value).alias(f.name))
    return checked.where(F.size("errors") == 0).select(*columns)


def dead_letters(checked: DataFrame, at: Column | None = None) -> DataFrame:
    """``key, error, value, timestamp`` of the records with errors.

    ``value`` is the published letter, JSON of the error and the record as it came; the key is the
    record's user id, or empty.
    """
    user = F.try_variant_get(F.col("record"), "$.user_id", "string")
    error = F.array_join("errors", "; ")
    letter = F.when(
        F.col("record").isNotNull(), F.to_json(F.struct(error.alias("error"), F.col("record").alias("event")))
    ).otherwise(F.to_json(F.struct(error.alias("error"), F.col("value").cast("string").alias("event"))))
    at = F.col("timestamp") if at is None else at
    return checked.where(F.size("errors") > 0).select(
        F.coalesce(user, F.lit("")).alias("key"), error.alias("error"), letter.alias("value"), at.alias("timestamp")
    )


def read_letters(letters: DataFrame) -> DataFrame:
    """Published letters back as ``key, error, event, timestamp``; the event stays JSON text."""
    body = F.from_json(F.col("value").cast("string"), "error string, event string")
    return letters.select("key", body["error"].alias("error"), body["event"].alias("event"), "timestamp")


def recent_letters(letters: DataFrame, limit: int = 8, *tie_break: str) -> DataFrame:
    """The newest letters over all partitions; letters without a time come last."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    return letters.orderBy(F.col("timestamp").desc_nulls_last(), *tie_break).limit(limit)


SHOWN_CHARS = 160  # fixed value: what a report shows of a reason


def first_clause(error: Column) -> Column:
    """First clause of an error on one line."""
    clause = F.split_part(F.regexp_replace(error, r"\s+", " "), F.lit(" ("), F.lit(1))
    return F.when(error.isNull() | (error == ""), "Unknown error").otherwise(clause)


def short_error(error: Column) -> Column:
    """The first clause as reports show it."""
    return F.substring(first_clause(error), 1, SHOWN_CHARS)


def letter_reasons(letters: DataFrame) -> DataFrame:
    """Letters per reason. Reasons are told apart whole and cut for display afterwards."""
    counted = letters.groupBy(first_clause(F.col("error")).alias("whole")).agg(F.count(F.lit(1)).alias("letters"))
    return counted.select(F.substring("whole", 1, SHOWN_CHARS).alias("reason"), "letters")


def dead_letter_report(letters: DataFrame, limit: int = 8, *tie_break: str) -> DataFrame:
    """One row for published letters: how many there are (``total``) and the newest ones (``recent``, newest first)."""
    shown = F.struct("error", "event", F.unix_millis("timestamp").alias("timestamp_ms"))
    order = [F.desc_nulls_last("timestamp"), *map(F.col, tie_break)]
    placed = recent_letters(letters, limit, *tie_break).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # limit rows
    newest = F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("letter")))), lambda x: x["letter"])
    total = letters.agg(F.count(F.lit(1)).alias("total"))
    return placed.agg(newest.alias("recent")).select(total.scalar().alias("total"), "recent")
