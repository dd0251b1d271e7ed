import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitor, serving, traffic


def now():
    return F.lit("2024-01-01 00:01:00").cast("timestamp")


def lookups(spark, values):
    return spark.createDataFrame([("u", True, float(v)) for v in values], "user_id string, found boolean, latency_ms double")


def test_percentile_rules(spark):
    df = lookups(spark, range(1, 21))
    assert tuple(serving.serving_latency(df).first()) == (20, 10.5, 20.0)
    assert tuple(serving.benchmark_latency(df).first()) == (20, 10.5, 19.0, 20.0)


@pytest.mark.parametrize("cell", [1, 7, 256])
@pytest.mark.parametrize("values", [[3.25], [2.0, 1.0], [5.0] * 7 + [0.125, -3.5], [i * 0.37 % 5 for i in range(333)]])
def test_percentiles_equal_sorted_list(spark, values, cell):
    got = serving.serving_latency(lookups(spark, values), cell).first()
    ordered = sorted(values)
    assert got.samples == len(values)
    assert got.p50_ms == pytest.approx(statistics.median(ordered), abs=6e-4)
    assert got.p95_ms == pytest.approx(ordered[min(len(ordered) - 1, int(0.95 * len(ordered)))], abs=6e-4)
    bench = serving.benchmark_latency(lookups(spark, values), cell).first()
    for name, p in (("p95_ms", 95), ("p99_ms", 99)):
        rank = min(len(ordered) - 1, int(round((len(ordered) - 1) * p / 100)))
        assert bench[name] == pytest.approx(ordered[rank], abs=6e-3)


def test_no_samples(spark):
    assert tuple(serving.serving_latency(lookups(spark, [])).first()) == (0, None, None)


def vectors(spark):
    return spark.createDataFrame([("a", 42.5, 1_700_000_000_000), ("c", None, None)], "user_id string, spend_5m double, last_seen_ms bigint")


def test_lookup(spark):
    row = serving.lookup(vectors(spark), "a", now()).first()
    assert row.spend_5m == 42.5 and row.freshness_ms > 0
    assert serving.lookup(vectors(spark), "nobody", now()).collect() == []


def test_batch_keeps_order_and_duplicates(spark):
    rows = serving.lookup_batch(vectors(spark), ["b", "a", "c", "a"], now()).collect()
    assert [(r.user_id, r.found) for r in rows] == [("b", False), ("a", True), ("c", True), ("a", True)]
    assert rows[0].freshness_ms is None and rows[2].freshness_ms is None
    odd = serving.lookup_batch(vectors(spark), ['q"uote\\', "é"], now()).collect()
    assert [r.user_id for r in odd] == ['q"uote\\', "é"]
    for bad in ([], ["x"] * 1001):
        with pytest.raises(ValueError):
            serving.lookup_batch(vectors(spark), bad, now())


def test_sample_and_log(spark):
    users = spark.createDataFrame([(f"u{i:02d}",) for i in range(12)], "user_id string")
    ids = [r.user_id for r in serving.sample_users(users, 5).collect()]
    assert len(ids) == 5 and ids == sorted(ids)
    answers = spark.createDataFrame([("a", True, 1.0, None), ("b", False, 2.0, None)], "user_id string, found boolean, latency_ms double, at timestamp")
    assert [r.user_id for r in serving.lookup_log(answers).collect()] == ["a"]
    assert tuple(serving.hit_rate(answers).first()) == (2, 0.5)


PROGRESS = "query string, batch_id bigint, timestamp string, num_input_rows bigint, input_rows_per_second double, processed_rows_per_second double, trigger_execution_ms bigint, state_rows bigint"


def progress(spark, ages=(), rates=(1.0, 2.0)):
    at = dt.datetime(2024, 1, 1, 0, 1)
    rows = [(q, 1, (at - dt.timedelta(seconds=a)).strftime("%Y-%m-%dT%H:%M:%S.000Z"), 1, *rates, 5, 0) for q, a in zip(monitor.QUERY_NAMES, ages)]
    return spark.createDataFrame(rows, PROGRESS)


def test_health_states(spark):
    state = lambda *ages: monitor.health(progress(spark, ages), now()).first()
    assert state().state == "starting"
    assert state(5, 61, 3).state == "stalled" and state(60, 1, 1).state == "live"
    assert state(5).reporting == 1 and state(-30).newest_ms == 0
    unreadable = progress(spark, (5,)).withColumn("timestamp", F.lit("soon"))
    assert monitor.health(unreadable, now()).first().state == "starting"
    assert tuple(monitor.kpi_report(progress(spark, (1, 2, 3)), now()).first()) == (3, 3, 0, True)
    assert monitor.kpi_report(progress(spark, (1, 2)), now()).first().good is False
    assert monitor.kpi_report(progress(spark, (1, 2, 99)), now()).first().good is False


@pytest.mark.parametrize("rates,expected", [((1000.0, 500.0), (1.5, "Busy")), ((95.0, 100.0), (0.95, "Busy")), ((5.0, 0.0), (None, "Healthy")), ((1.0, 2.0), (0.5, "Healthy"))])
def test_capacity(spark, rates, expected):
    got = {r.query: (r.utilization, r.status) for r in monitor.capacity(progress(spark, (1,), rates)).collect()}
    assert got["window_5m"] == expected and got["profile"] == (None, "Starting")


def test_flatten_fills_gaps(spark):
    rows = [('{"name":"profile"}',), ('{"name":"window_5m","batchId":3,"inputRowsPerSecond":1.005,"durationMs":{"triggerExecution":7},"stateOperators":[{"numRowsTotal":2},{"numRowsTotal":3}]}',)]
    got = {r.query: r for r in monitor.flatten_progress(spark.createDataFrame(rows, "json string")).collect()}
    assert tuple(got["profile"])[1:8] == (-1, "", 0, 0.0, 0.0, 0, 0)
    assert (got["window_5m"].state_rows, got["window_5m"].trigger_execution_ms) == (5, 7)


def test_stats_report(spark):
    latest = spark.createDataFrame([("profile", 1, "", 0, 1000.5, 0.0, 0, 0)], PROGRESS)
    users = spark.createDataFrame([(4,)], "users bigint")
    row = monitor.stats_report(latest, users, serving.serving_latency(lookups(spark, [])), now()).first()
    assert (row.events_per_minute, row.online_store_keys, row.window_5m_batch_id, row.samples) == (60030, 4, None, 0)


def test_throughput_history_equals_brute_force(spark):
    base = 1_704_067_200_000
    samples = [(base + t * 1000, (t * 7919) % 501) for t in list(range(0, 1500, 7)) + [1500, 1500, 4000, 4300]]
    df = spark.createDataFrame(samples, "ms bigint, events_per_minute bigint").select(F.timestamp_millis("ms").alias("at"), "events_per_minute")
    got = {r.ms: r.peak for r in monitor.throughput_history(df).select(F.unix_millis("at").alias("ms"), "peak").collect()}
    assert got == {t: max(v for u, v in samples if t - 300_000 <= u <= t) for t, _ in samples}


def test_traffic(spark):
    rows = [(f"u{i % 20}",) if i % 3 else ("u0",) for i in range(300)]
    row = traffic.top_user_share(spark.createDataFrame(rows, "user_id string")).first()
    counts = sorted(((r, sum(x == r for x in rows)) for r in set(rows)), key=lambda x: -x[1])
    assert (row.users, row.top_users, row.events) == (20, 2, 300)
    assert row.top_share == pytest.approx(sum(c for _, c in counts[:2]) / 300, abs=1e-6)
    at = dt.datetime(2024, 1, 1)
    topic = spark.createDataFrame([(p, o, at + dt.timedelta(seconds=o)) for p in (0, 1) for o in range(61)], "partition int, offset bigint, timestamp timestamp")
    assert traffic.topic_size(topic).first().messages == 122
    assert tuple(traffic.ingest_rate(topic).first()) == (120, 120)
    outcomes = spark.createDataFrame([(o, at) for o in ["delivered"] * 5 + ["failed", "dlq"]], "outcome string, timestamp timestamp")
    assert tuple(traffic.delivery_counters(outcomes).first()) == (6, 5, 1, 1)
    assert traffic.delivery_rates(outcomes).first().per_minute == 30.0
