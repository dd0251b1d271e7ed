import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators.decode import decode_events, decode_messages, decode_rejects, encode_events, encode_payload, split_frames
from tidemark.operators.validate import (
    check_records, dead_letter_report, dead_letters, letter_reasons, read_letters, recent_letters, short_error, valid_events,
)
from tidemark.plans.wire import QUERIES
from tidemark.sources.contracts import packaged_schemas

SCHEMAS = packaged_schemas()
READER = SCHEMAS[2]
FRAMES = {
    "old": "00000000010265066f6c6408766965770470310a626f6f6b7300000000000024400655534480e8c9d09d68",
    "new": "00000000020265066e657708766965770470310a626f6f6b7300000000000024400655534480e8c9d09d68020473310206696f73",
    "bad_magic": "01676172626167652d776974686f75742d6d616769632d62797465",
    "unknown_schema": "000000006302651c756e6b6e6f776e2d736368656d6108766965770470310a626f6f6b7300000000000024400655534480e8c9d09d680000",
    "malformed": "00000000020265066e6577",
    "huge id": "00ffffffff78",
    "short": "0000",
    "empty": "",
    "null": None,
}
REASONS = {
    "bad_magic": "bad_magic", "unknown_schema": "unknown_schema", "malformed": "malformed", "huge id": "unknown_schema",
    "short": "malformed", "empty": "bad_magic", "null": "null_value",
}


def raw(spark, frames):
    rows = [(k.encode(), None if h is None else bytearray.fromhex(h)) for k, h in frames.items()]
    return spark.createDataFrame(rows, "key binary, value binary").withColumn("timestamp", F.current_timestamp())


def test_mixed_versions(spark):
    got = {r.user_id: r for r in decode_events(raw(spark, FRAMES), SCHEMAS, READER).withColumn("ms", F.unix_millis("event_ts")).collect()}
    assert set(got) == {"old", "new"}
    assert (got["old"].device, got["old"].session_id) == (None, None)
    assert (got["new"].device, got["new"].session_id) == ("ios", "s1")
    assert {(r.amount, r.category, r.currency, r.ms) for r in got.values()} == {(10.0, "books", "USD", 1790683200000)}


def test_every_reject_has_a_reason(spark):
    got = {bytes(r.key).decode(): r.reason for r in decode_rejects(raw(spark, FRAMES), SCHEMAS, READER).collect()}
    assert got == REASONS


def test_no_writers_is_an_error(spark):
    with pytest.raises(ValueError):
        decode_events(raw(spark, FRAMES), {}, READER)


def test_frame_ids_survive(spark):
    ids = spark.createDataFrame([(1,), (258,), (2147483647,)], "id int")
    back = split_frames(ids.withColumn("value", wire.frame(F.col("id"), F.lit(b"xyz"))))
    assert all(r.id == r.schema_id and bytes(r.payload) == b"xyz" and r.valid_magic for r in back.collect())


def test_negative_ids_survive_and_longer_ones_keep_their_low_bytes(spark):
    ids = spark.createDataFrame([(-1, -1), (-(2**31), -(2**31)), (2**32 + 5, 5), (-(2**32) + 7, 7), (2**31, -(2**31))], "id bigint, want int")
    back = split_frames(ids.withColumn("value", wire.frame(F.col("id"), F.lit(b"xyz"))))
    assert all(r.want == r.schema_id and bytes(r.payload) == b"xyz" for r in back.collect())


def test_roundtrip_of_large_event_ids(spark, tmp_path):
    """Ids past 271 181 make negative schema ids, past 542 352 ones beyond 32 bits."""
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(1)
    numbers = [0, 271_181, 271_182, 542_352, 542_353, 6_000_000]
    source.withColumn("event_id", F.explode(F.array(*[F.lit(n).cast("bigint") for n in numbers]))).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.n: r for r in QUERIES["frame_roundtrip"](spark, str(tmp_path)).collect()}
    assert {n: r.schema_id for n, r in got.items()} == {n: (2**31 - 1 - n * 7919 + 2**31) % 2**32 - 2**31 for n in numbers}
    assert all(r.payload.startswith("u") for r in got.values())


def test_unregistered_schema_fails_fast(spark):
    with pytest.raises(ValueError):
        encode_events(spark.range(1), SCHEMAS, 7)


@pytest.mark.parametrize("codec", ["avro_arrow", "json"])
def test_round_trip(spark, codec):
    rng = random.Random(1)
    texts = ["", "a", "ünïcödé ✓", "x" * 63, "x" * 64, "y" * 9000, "é" * 5000]
    rows = [
        (str(i), rng.choice(texts[1:]), "view", rng.choice(texts), "c", rng.choice([0.0, -1.5, 1e300, 12.34]), "EUR",
         rng.choice([0, 1, -1, 63, 64, -65, 2**40, -(2**40)]), rng.choice([None, *texts]), rng.choice([None, "web"]))
        for i in range(300)
    ]
    cols = "event_id string, user_id string, event_type string, product_id string, category string, amount double, currency string, ms bigint, session_id string, device string"
    ev = spark.createDataFrame(rows, cols).withColumn("event_ts", F.timestamp_millis("ms")).repartition(3)
    value = wire.frame(F.lit(2), encode_payload(READER, codec))
    sent = ev.select(value.alias("value"), F.current_timestamp().alias("timestamp"))
    back = decode_events(sent, SCHEMAS, READER, codec).select(*[c for c in ev.columns if c not in ("ms", "event_ts")], F.unix_millis("event_ts").alias("ms"))
    assert back.select(*sorted(back.columns)).exceptAll(ev.drop("event_ts").select(*sorted(back.columns))).count() == 0
    assert back.count() == 300


def test_damaged_bytes_never_raise(spark):
    rng = random.Random(2)
    good = bytes.fromhex(FRAMES["new"])
    frames = {}
    for i in range(400):
        b = bytearray(good[: rng.randrange(6, len(good) + 1)])
        for _ in range(rng.randrange(3)):
            b[rng.randrange(5, len(b))] = rng.randrange(256)
        frames[str(i)] = b.hex()
    for i in range(5, len(good)):
        frames[f"cut{i}"] = good[:i].hex()
    out = decode_messages(raw(spark, frames), SCHEMAS, READER).collect()
    assert len(out) == len(frames)
    assert all(r.reason == "malformed" for r in out if bytes(r.key).startswith(b"cut"))


def test_null_user_in_json(spark):
    frames = {"a": "0000000002" + b'{"event_id":"1","amount":1}'.hex(), "b": "0000000002" + b"{bad".hex(), "c": "0000000002" + b'{"user_id":"u"}'.hex()}
    rows = {bytes(r.key): r for r in decode_messages(raw(spark, frames), SCHEMAS, READER, "json").collect()}
    assert (rows[b"a"].reason, rows[b"b"].reason, rows[b"c"].reason) == ("null_user", "malformed", None)
    assert rows[b"c"].e.currency == "USD"


VALID = '"event_id":"e","user_id":"u","event_type":"view","product_id":"p","category":"c"'
RECORDS = {
    "{%s,\"amount\":1,\"event_ts\":5}" % VALID: None,
    "{%s,\"amount\":1.25,\"event_ts\":5,\"currency\":\"EUR\",\"device\":null,\"session_id\":\"s\",\"more\":1}" % VALID: None,
    "{%s,\"amount\":1e3,\"event_ts\":5}" % VALID: None,
    "{%s,\"event_ts\":5}" % VALID: "amount: required field is missing",
    "{%s,\"amount\":\"12.99 USD\",\"event_ts\":5}" % VALID: "amount: expected double (got STRING)",
    "{%s,\"amount\":true,\"event_ts\":5}" % VALID: "amount: expected double (got BOOLEAN)",
    "{%s,\"amount\":1,\"event_ts\":\"yesterday\"}" % VALID: "event_ts: expected timestamp-millis (got STRING)",
    "{%s,\"amount\":1,\"event_ts\":1.0}" % VALID: "event_ts: expected timestamp-millis (got DECIMAL)",
    "{%s,\"amount\":1,\"event_ts\":5,\"currency\":null}" % VALID: "currency: expected string (got VOID)",
    "{%s,\"amount\":1,\"event_ts\":5,\"device\":3}" % VALID: "device: expected string (got BIGINT)",
    ("{%s,\"amount\":1,\"event_ts\":5}" % VALID).replace('"user_id":"u",', ""): "user_id: required field is missing",
    ("{%s,\"amount\":1,\"event_ts\":5}" % VALID).replace('"u"', "5"): "user_id: expected string (got BIGINT)",
    ("{%s,\"amount\":1,\"event_ts\":5}" % VALID).replace('"u"', "null"): "user_id: expected string (got VOID)",
    "{bad": "record: not a JSON object",
    "[1]": "record: not a JSON object",
}


def checked(spark):
    df = spark.createDataFrame([(r,) for r in RECORDS] + [(None,)], "value string")
    return check_records(df.withColumn("timestamp", F.current_timestamp()), READER)


def test_contract_check(spark):
    got = {r.value: list(r.errors) for r in checked(spark).select("value", "errors").collect()}
    assert got == {v: [e] if e else [] for v, e in RECORDS.items()} | {None: ["record: not a JSON object"]}
    events = valid_events(checked(spark), READER).orderBy("amount").collect()
    assert [(r.amount, r.currency, r.session_id) for r in events] == [(1.0, "USD", None), (1.25, "EUR", "s"), (1000.0, "USD", None)]


def test_dead_letters(spark):
    letters = dead_letters(checked(spark))
    rows = letters.collect()
    assert len(rows) == sum(e is not None for e in RECORDS.values()) + 1
    assert {r.key for r in rows} == {"u", "", "5"}
    back = read_letters(letters)
    assert back.where("error like 'amount: exp%STRING%'").select(F.get_json_object("event", "$.amount")).first()[0] == "12.99 USD"
    assert recent_letters(back, 3).count() == 3
    reasons = {r.reason: r.letters for r in letter_reasons(back).collect()}
    assert reasons["amount: expected double"] == 2
    with pytest.raises(ValueError):
        recent_letters(back, 51)


def test_short_error(spark):
    rows = [("a  b\n c (d) e",), (None,), ("",), ("x" * 500,)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string").select(short_error(F.col("e"))).collect()]
    assert got == ["a b c", "Unknown error", "Unknown error", "x" * 160]


def test_values_that_do_not_fit_the_reader_are_malformed(spark):
    """One writer schema with wider numbers spoils its own messages only."""
    record = '{"type": "record", "name": "R", "fields": [{"name": "user_id", "type": "string"}, {"name": "n", "type": "%s"}]}'
    writers, reader = {1: record % "int", 2: record % "long", 3: record % "string"}, record % "int"
    rows = spark.createDataFrame([("a", 2, 7), ("b", 2, 2**40), ("c", 1, 9)], "user_id string, id int, n long")
    parts = [
        rows.where(F.col("id") == i).select(wire.frame(F.lit(i), encode_payload(writers[i])).alias("value"), F.current_timestamp().alias("timestamp"))
        for i in (1, 2)
    ]
    text = rows.limit(1).withColumn("n", F.lit("x")).select(wire.frame(F.lit(3), encode_payload(writers[3])).alias("value"), F.current_timestamp().alias("timestamp"))
    got = decode_messages(parts[0].unionByName(parts[1]).unionByName(text), writers, reader).select("e.*", "reason").collect()
    assert sorted((r.user_id or "", r.n or 0, r.reason or "") for r in got) == [("", 0, "malformed"), ("", 0, "malformed"), ("a", 7, ""), ("c", 9, "")]


def test_letter_report(spark):
    rows = [("k", f"bad {i} (x)", "{}", i) for i in range(12)] + [("k", "old", "{}", None)]
    letters = spark.createDataFrame(rows, "key string, error string, event string, at int").select(
        "key", "error", "event", F.timestamp_seconds("at").alias("timestamp")
    )
    report = dead_letter_report(letters, 3).first()
    assert report.total == 13 and [(r.error, r.timestamp_ms) for r in report.recent] == [("bad 11 (x)", 11000), ("bad 10 (x)", 10000), ("bad 9 (x)", 9000)]
    nothing = dead_letter_report(letters.limit(0)).first()
    assert (nothing.total, nothing.recent) == (0, [])


def test_decoding_where_workers_lack_the_package(tmp_path):
    """Only the driver's own path has the package, added after the start; workers start in another folder."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {repo!r})
from tidemark.operators.decode import decode_events
from tidemark.plans.derived import messages
from tidemark.sources.contracts import packaged_schemas
schemas = packaged_schemas()
print(len(decode_events(messages(spark, "/root/testdata/sf0.001"), schemas, schemas[2]).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout) > 0, done.stderr[-3000:]
