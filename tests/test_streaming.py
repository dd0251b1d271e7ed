import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.decode import encode_events, events_of, replayed
from tidemark.operators.expiry import mark_lives
from tidemark.operators.windows import windowed_features
from tidemark.plans import streams
from tidemark.session import shared_dir, streaming_session
from tidemark.sources.contracts import packaged_schemas
from tidemark.sources.events import event_source
from tidemark.sources.feature_store import FeatureStore
from tidemark.streaming import jobs, sinks
from tidemark.streaming.expiry import mark_lives_stream

SCHEMA = "event_id string, user_id string, event_type string, product_id string, category string, amount double, event_ts timestamp, device string"
EVENTS = "event_id string, user_id string, event_type string, product_id string, category string, amount double, currency string, event_ts timestamp, session_id string, device string"
LOG = "user_id string, grp string, seq long, guard long, write_ts timestamp"
NOON = dt.datetime(2024, 5, 1, 12)


def put(spark, path, *rows):
    data = [(str(i), u, "view", "p", "c", 1.0, NOON + dt.timedelta(minutes=m), "web") for i, (u, m) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(session, path, root, window, slide):
    seen = {}

    def keep(batch, batch_id):
        seen[batch_id] = {(r.user_id, r.window_end.strftime("%H:%M")): r.event_count for r in batch.collect()}

    stream = event_source(session, "parquet", path, {"maxFilesPerTrigger": "1"}, SCHEMA)
    q = jobs.start(windowed_features(stream, window, slide), "w", keep, root, {"availableNow": True}, "update")
    jobs.finish([q])
    dropped = {p.batchId: sum(o.numRowsDroppedByWatermark for o in p.stateOperators) for p in q.recentProgress}
    return seen, dropped


@pytest.mark.parametrize("window,slide,kept,lost", [("5 minutes", "1 minute", 0, 5), ("1 hour", "10 minutes", 6, 0)])
def test_late_rows_are_judged_per_window(spark, window, slide, kept, lost):
    root = shared_dir(spark, "late")
    session = streaming_session(spark, 2)
    for rows in ([("u1", 0), ("u1", 20)], [("u2", 20)], [("u1", 10)], [("u2", -55)]):
        put(spark, f"{root}/in", *rows)
    seen, dropped = run(session, f"{root}/in", f"{root}/cp", window, slide)
    assert len(seen[2]) == kept and dropped[2] == lost
    assert len(seen[3]) == 0 and dropped[3] == (5 if window.startswith("5") else 6)
    if kept:  # the late event joins windows that hold the earlier ones
        assert seen[2][("u1", "12:20")] == 2 and seen[2][("u1", "13:10")] == 2


def test_width_follows_the_events(spark, monkeypatch):
    """State and comparison of ever more events would grow in each of a fixed number of tasks."""
    monkeypatch.setattr(streams, "ROWS_PER_TASK", 100)
    assert int(streams._session(spark, spark.range(2000)).conf.get("spark.sql.shuffle.partitions")) == 20
    assert int(streams._session(spark, spark.range(1)).conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism


def test_replayed_batch_changes_nothing(spark):
    store = FeatureStore(spark, shared_dir(spark, "replay"))
    now = F.lit(NOON).cast("timestamp")
    rows = [(str(i), f"u{i % 3}", "view", "p", "c", 1.0, NOON + dt.timedelta(minutes=i), "web") for i in range(9)]
    batch = spark.createDataFrame(rows, SCHEMA)
    sink = sinks.profile_sink(store, now)
    sink(batch.limit(6), 0)
    sink(batch, 1)
    before = sorted(map(tuple, store.vectors().collect()))
    sink(batch, 1)
    sink(batch.limit(6), 0)
    assert sorted(map(tuple, store.vectors().collect())) == before


def test_job_raises_when_a_query_fails(spark):
    root = shared_dir(spark, "fail")
    put(spark, f"{root}/in", ("u1", 0))
    session = streaming_session(spark, 2)

    def broken(batch, batch_id):
        raise RuntimeError("sink is down")

    stream = event_source(session, "parquet", f"{root}/in", {}, SCHEMA)
    q = jobs.start(stream, "broken", broken, root, {"availableNow": True})
    with pytest.raises(Exception, match="sink is down"):
        jobs.supervise(session, [q], every=1)


def test_publishing_under_an_unregistered_schema_fails_first(spark):
    with pytest.raises(ValueError):
        jobs.start_publish(spark.range(1), {1: "{}"}, 2, None, None, "x")


def test_source_kinds(spark):
    with pytest.raises(ValueError):
        event_source(spark, "queue", "x")


def test_progress_keeps_more_batches_than_a_query_remembers(spark, tmp_path):
    session = streaming_session(spark, 1)
    for i in range(112):
        spark.range(1).selectExpr(f"{i} as n").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    progress = jobs.ProgressLog(session, str(tmp_path / "progress"))
    stream = session.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        stream.writeStream.queryName("many").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    jobs.supervise(session, [query], progress, every=60)
    progress.close()
    rows = spark.read.parquet(str(tmp_path / "progress")).where("num_input_rows > 0")
    assert sorted(r.batch_id for r in rows.collect()) == list(range(112))


def test_supervise_watches_its_own_queries(spark, tmp_path):
    session = streaming_session(spark, 1)
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def begin(name, sink):
        stream = session.readStream.schema("id long").parquet(str(tmp_path / "in"))
        return jobs.start(stream, name, sink, str(tmp_path / "c"), {"availableNow": True})

    jobs.finish([begin("earlier", lambda df, n: None)])
    progress = jobs.ProgressLog(session, str(tmp_path / "progress"))

    def broken(df, n):
        raise RuntimeError("sink gave up")

    query = begin("own", broken)
    with pytest.raises(Exception, match="sink gave up"):
        jobs.supervise(session, [query], progress, every=60)
    assert not query.isActive
    progress.close()


def test_contracts_are_asked_for_at_every_batch(spark, tmp_path):
    """The second version is registered between two batches of one running job; rejects of the first are replayed."""
    schemas = packaged_schemas()
    known = {1: schemas[1]}
    session = streaming_session(spark, 2)

    def send(number, *users):
        rows = [(f"e{u}", u, "view", "p1", "c", 1.0, "USD", NOON, None, "ios") for u in users]
        events = spark.createDataFrame(rows, EVENTS)
        sent = encode_events(events, schemas, 2, "json").select("key", "value", F.col("event_ts").alias("timestamp"))
        sent.coalesce(1).write.parquet(str(tmp_path / "raw" / f"n={number}"))

    def contracts():
        asked.append(sorted(known))
        return dict(known), schemas[2]

    asked = []
    send(0, "early")
    raw = event_source(session, "parquet", str(tmp_path / "raw" / "*"), {"maxFilesPerTrigger": "1"}, "key binary, value binary, timestamp timestamp")
    query = jobs.start_refreshing_ingest(raw, contracts, str(tmp_path / "out"), str(tmp_path / "c"), "json", {"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        known[2] = schemas[2]
        send(1, "late")
        query.processAllAvailable()
    finally:
        query.stop()
    assert asked == [[1], [1, 2]]
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.status, r.user_id, r.reason) for r in rows.collect()} == {("event", "late", None), ("reject", None, "unknown_schema")}
    rejects = rows.where("status = 'reject'").select("value", F.col("kafka_ts").alias("timestamp"), "schema_id", "reason")
    again = replayed(rejects, *contracts(), "json")
    assert [r.user_id for r in events_of(again).collect()] == ["early"] and [r.rejected_for for r in again.collect()] == ["unknown_schema"]


def test_a_batch_that_is_there_is_not_written_again(spark, tmp_path):
    schemas = packaged_schemas()
    sink = sinks.ingest_sink(lambda: (schemas, schemas[2]), str(tmp_path / "out"), "json")
    event = spark.createDataFrame([("e", "u", "view", "p1", "c", 1.0, "USD", NOON, None, "ios")], EVENTS)
    batch = encode_events(event, schemas, 2, "json").select("key", "value", F.col("event_ts").alias("timestamp"))
    sink(batch, 0)
    before = {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("_metadata.file_path").collect()}
    sink(batch, 0)
    sink(batch, 1)
    after = {r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("_metadata.file_path").collect()}
    assert before < after and len(after) == 2


def test_publishing_commits_both_outputs_at_once(spark, tmp_path, monkeypatch):
    """The write of a batch fails, the job starts again: every record is there once, and nothing is seen before."""
    good = '{"event_id": "1", "user_id": "u", "event_type": "view", "product_id": "p", "category": "c", "amount": 1.0, "currency": "USD", "event_ts": 1714564800000}'
    rows = [(good, NOON), (good.replace('"user_id": "u", ', ""), NOON), ("broken", NOON)]
    spark.createDataFrame(rows, "value string, timestamp timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    session, schemas = streaming_session(spark, 1), packaged_schemas()
    out = str(tmp_path / "out")

    def publish():
        records = event_source(session, "parquet", str(tmp_path / "in"), {}, "value string, timestamp timestamp")
        jobs.finish([jobs.start_publish_files(records, schemas, 2, out, str(tmp_path / "c"), "json", {"availableNow": True})])

    letters = sinks.dead_letters
    monkeypatch.setattr(sinks, "dead_letters", lambda checked: letters(checked).withColumn("value", F.raise_error(F.lit("letters are down"))))
    with pytest.raises(Exception, match="letters are down"):
        publish()
    assert sinks.read_published(spark, out, "messages").count() == 0
    monkeypatch.undo()
    publish()
    publish()
    assert sinks.read_published(spark, out, "messages").count() == 1 and sinks.read_published(spark, out, "letters").count() == 2


def test_state_read_back(spark, tmp_path):
    put(spark, f"{tmp_path}/in", ("u1", 0), ("u2", 1))
    session = streaming_session(spark, 2)
    run(session, f"{tmp_path}/in", str(tmp_path / "c"), "5 minutes", "1 minute")
    rows = jobs.state_rows(session, str(tmp_path / "c" / "w")).collect()
    assert [(r.operator_id, r.rows) for r in rows] == [(0, 10)]  # five windows each


def test_a_job_that_ends_keeps_no_stores_and_shuffles(spark, tmp_path):
    """Stores stayed open on their executors, and shuffles on disk, as many as state partitions and batches."""
    local = [spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())]
    local += [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def held(pattern):
        return {p for d in local for p in Path(d).rglob(pattern)}

    rows = [(str(i), f"u{i}", "view", "p", "c", 1.0, NOON + dt.timedelta(minutes=i), "web") for i in range(20)]
    for number in range(2):
        spark.createDataFrame(rows[10 * number : 10 * number + 10], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/n={number}")
    session = streaming_session(spark, 2, once=True)
    before = held("CURRENT"), held("shuffle_*.data")
    store = FeatureStore(session, f"{tmp_path}/store")
    stream = event_source(session, "parquet", f"{tmp_path}/in/*", {"maxFilesPerTrigger": "1"}, SCHEMA)
    queries = jobs.run_features(stream, store, f"{tmp_path}/c", now=F.lit(NOON).cast("timestamp"))
    for _ in range(50):  # removal does not wait
        left = held("CURRENT") - before[0], held("shuffle_*.data") - before[1]
        if not any(left):
            break
        time.sleep(0.2)
    assert left == (set(), set())
    assert [q.isActive for q in queries] == [False] * 3 and store.vectors().count() == 20


def test_state_of_a_window_follows_what_it_holds(spark, tmp_path):
    """A window with one product took 832 bytes of registers."""
    put(spark, f"{tmp_path}/in", ("u1", 0), ("u2", 1))
    session = streaming_session(spark, 2)
    run(session, f"{tmp_path}/in", str(tmp_path / "c"), "5 minutes", "1 minute")
    state = session.read.format("statestore").load(str(tmp_path / "c" / "w")).select("value.*")
    state = state.toDF(*[f"c{i}" for i in range(len(state.columns))])
    sketches = [f.name for f in state.schema.fields if f.dataType.typeName() == "binary"]
    widest = state.select(F.max(F.greatest(*[F.length(c) for c in sketches]))).first()[0]
    assert len(state.columns) < 30 and len(sketches) == 2 and widest <= 40


def test_expiring_state_equals_the_batch(spark, tmp_path):
    rows = [("u", "5m", 0, 9, 0), ("u", "5m", 1, 5, 30), ("v", "1h", 2, 3, 40), ("u", "1h", 3, 1, 50), ("u", "5m", 4, 5, 109), ("u", "5m", 5, 4, 170), ("v", "1h", 6, 1, 200)]
    log = spark.createDataFrame([(u, g, s, guard, NOON + dt.timedelta(minutes=m)) for u, g, s, guard, m in rows], LOG)
    for number, part in enumerate(("seq < 3", "seq >= 3 and seq < 5", "seq >= 5")):
        log.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={number}"))
    stream = event_source(streaming_session(spark, 2), "parquet", str(tmp_path / "in" / "*"), {"maxFilesPerTrigger": "1"}, LOG)
    sink = sinks.to_files(str(tmp_path / "out"))
    jobs.finish([jobs.start(mark_lives_stream(stream, 3600), "lives", sink, str(tmp_path / "c"), {"availableNow": True}, "append")])
    columns = ["user_id", "seq", "life", "accepted"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    assert got == sorted(map(tuple, mark_lives(log, 3600).select(*columns).collect()))
    assert {s: a for _, s, _, a in got} == {0: True, 1: False, 2: True, 3: True, 4: False, 5: True, 6: True}
