"""Streaming jobs run over the given events to the end, their results read back as tables.

Events are first laid out as files in slices of event time, so a job sees several micro-batches. All
files live below the shared folder of the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.decode import decode_messages, events_of, replayed
from tidemark.operators.monitor import latest_progress
from tidemark.operators.validate import read_letters
from tidemark.operators.windows import windowed_features
from tidemark.plans import sql
from tidemark.plans.derived import at, events, expiring_log, messages, plain, record_texts
from tidemark.plans.windows import DISTINCT, SPECS, distinct_checked
from tidemark.plans.store import FORGET_SECONDS, LIVES_MARKED
from tidemark.plans.wire import ERRORS
from tidemark.plans.wire import ORACLES as WIRE
from tidemark.session import shared_dir, streaming_session, tasks_for
from tidemark.sources.contracts import contracts_table, packaged_schemas, writer_schemas
from tidemark.sources.events import MESSAGE_SCHEMA, event_source, written_events
from tidemark.sources.feature_store import FeatureStore
from tidemark.streaming import jobs
from tidemark.streaming.expiry import mark_lives_stream
from tidemark.streaming.sinks import read_published, to_files

SUBJECT = "user-events-value"
SLICE_ENDS = ["2024-01-11", "2024-01-21", None]  # the last slice is open and takes records without a time
JOB_NOW = "2024-02-01 00:00:00"  # every window is closed by then
ROWS_PER_FILE = 250_000
ROWS_PER_TASK = 25_000  # events whose windows one task keeps
WINDOWS_PER_TASK = 250_000  # emitted windows that one task compares
NOW_OR_NEVER = {"availableNow": True}
EVENT_SCHEMA = """event_id string, user_id string, event_type string, product_id string, category string,
amount double, currency string, event_ts timestamp, session_id string, device string"""


def _files(rows: DataFrame) -> int:
    """Files per slice, and so per micro-batch, for the rows there are."""
    return max(4, -(-rows.count() // (len(SLICE_ENDS) * ROWS_PER_FILE)))


def _session(spark: SparkSession, rows: DataFrame) -> SparkSession:
    """A streaming session as wide as the windows of these rows ask for."""
    width = max(spark.sparkContext.defaultParallelism, tasks_for(spark, rows.count(), ROWS_PER_TASK))
    return streaming_session(spark, width, once=True)


def _write_slice(rows: DataFrame, path: str, number: int, files: int) -> None:
    rows.repartition(files).write.parquet(f"{path}/slice={number}")


def _slices(rows: DataFrame, path: str, numbers, files: int, column: str = "event_ts") -> None:
    for i in numbers:
        begin = F.lit(True) if i == 0 else F.col(column) >= at(SLICE_ENDS[i - 1])
        end = F.col(column) < at(SLICE_ENDS[i]) if SLICE_ENDS[i] else F.lit(True)
        inside = begin & end if SLICE_ENDS[i] else begin | F.col(column).isNull()
        _write_slice(rows.where(inside), path, i, files)


def _read(session: SparkSession, path: str, schema: str, files: int) -> DataFrame:
    """The slices as a stream; files in order of writing, one slice per micro-batch."""
    return event_source(session, "parquet", f"{path}/slice=*", {"maxFilesPerTrigger": str(files)}, schema)


def _all_windows(spark: SparkSession, stream: DataFrame, root: str, grp: str) -> DataFrame:
    """Every window a stream emitted, in its last version."""
    window, slide, *_ = SPECS[grp]

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/windows/batch_id={batch_id}")

    query = jobs.start(windowed_features(stream, window, slide), f"all_{grp}", keep, f"{root}/checkpoints", NOW_OR_NEVER, "update")
    jobs.finish([query])
    emitted = spark.read.parquet(f"{root}/windows")
    rest = [c for c in emitted.columns if c not in ("user_id", "window_start", "batch_id")]
    dealt = emitted.repartition(tasks_for(spark, emitted.count(), WINDOWS_PER_TASK), "user_id", "window_start")
    return dealt.groupBy("user_id", "window_start").agg(*[F.max_by(c, "batch_id").alias(c) for c in rest])


def _windows(grp: str):
    def query(spark, sf):
        root = shared_dir(spark, f"stream-{grp}")
        ev = events(spark, sf)
        files = _files(ev)
        _slices(ev, f"{root}/events", range(3), files)
        session = _session(spark, ev)
        last = _all_windows(spark, _read(session, f"{root}/events", EVENT_SCHEMA, files), root, grp)
        window, slide, *_ = SPECS[grp]
        return plain(distinct_checked(last, windowed_features(ev, window, slide, exact=True), ["user_id", "window_start"]))

    return query


def _late(grp: str):
    """Events of one product arrive after everything else; only windows still open take them."""

    def query(spark, sf):
        root = shared_dir(spark, f"late-{grp}")
        ev = events(spark, sf)
        files = _files(ev)
        late = F.col("product_id") == "p00007"
        _write_slice(ev.where(~late), f"{root}/events", 0, files)
        # records without a time: they join no window but let the watermark take effect
        _write_slice(ev.where(F.col("product_id") == "p00008").withColumn("event_ts", F.lit(None).cast("timestamp")),
                     f"{root}/events", 1, files)
        _write_slice(ev.where(late), f"{root}/events", 2, files)
        session = _session(spark, ev)
        last = _all_windows(spark, _read(session, f"{root}/events", EVENT_SCHEMA, files), root, grp)
        return plain(distinct_checked(last, _in_time(ev, late, grp), ["user_id", "window_start"]))

    return query


def _in_time(ev: DataFrame, late, grp: str) -> DataFrame:
    """Exact distinct counts of each window over the events that came before it was closed."""
    window, slide, *_ = SPECS[grp]
    closed = ev.where(~late).agg((F.date_trunc("millisecond", F.max("event_ts")) - F.expr("interval 2 minutes")).alias("closed"))
    ended = F.col("window_end") <= closed.scalar()
    reach = F.col("event_ts") > closed.scalar() - F.expr(f"interval {window}")  # no earlier event lies in an open window
    parts = [windowed_features(ev.where(~late), window, slide, exact=True).where(ended),
             windowed_features(ev.where(reach), window, slide, exact=True).where(~ended)]
    return parts[0].unionByName(parts[1]).select("user_id", "window_start", *DISTINCT)


def _served(ev: DataFrame, grp: str) -> DataFrame:
    """Exact distinct counts of the window that each user is served after the last slice: of the newest window a slice
    touched, as far as events had arrived, the one of the user's last slice."""
    window, slide, *_ = SPECS[grp]
    parts, begin = [], None
    for i, end in enumerate(SLICE_ENDS):
        rows = windowed_features(ev.where(F.col("event_ts") < at(end)) if end else ev, window, slide, exact=True)
        rows = rows.where(F.col("last_event_ms") >= F.unix_millis(at(begin))) if begin else rows
        newest = rows.groupBy("user_id").agg(*[F.max_by(n, "window_end_ms").alias(n) for n in DISTINCT])
        parts.append(newest.withColumn("slice", F.lit(i)))
        begin = end
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("user_id").agg(*[F.max_by(n, "slice").alias(n) for n in DISTINCT])


def _vectors_checked(spark, sf, vectors: DataFrame) -> DataFrame:
    """Vectors with ``close_5m`` and ``close_1h`` in place of their approximate counts."""
    ev, out = events(spark, sf), vectors.drop("last_write")
    for grp in ("5m", "1h"):
        named = {f"{n}_{grp}": n for n in DISTINCT}
        guess = out.select("user_id", *[F.col(c).alias(n) for c, n in named.items()])
        close = distinct_checked(guess, _served(ev, grp), ["user_id"]).withColumnRenamed("distinct_close", f"close_{grp}")
        out = out.drop(*named).join(close, "user_id")
    return out


def _run_job(spark, sf, root):
    """The whole feature job, stopped before the last slice and started again from its checkpoints."""
    ev = events(spark, sf)
    session = _session(spark, ev)
    store = FeatureStore(session, f"{root}/store")
    progress = jobs.ProgressLog(session, f"{root}/progress")
    files = _files(ev)
    for part in ([0, 1], [2]):
        _slices(ev, f"{root}/events", part, files)
        stream = _read(session, f"{root}/events", EVENT_SCHEMA, files)
        queries = jobs.run_features(stream, store, f"{root}/checkpoints", now=at(JOB_NOW))
        progress.append(queries)
        progress.append(queries)  # nothing new: nothing written
    return FeatureStore(spark, f"{root}/store")


_VECTOR_DROPS = ["last_write"] + [f"distinct_{n}_{g}" for n in ("products", "categories") for g in ("5m", "1h")]


def _job_vectors(spark, sf):
    return _vectors_checked(spark, sf, _run_job(spark, sf, shared_dir(spark, "job")).vectors())


def _job_compacted(spark, sf):
    """The same vectors after the log was folded into a snapshot and cleared."""
    store = _run_job(spark, sf, shared_dir(spark, "compacted"))
    store.compact()
    store.vacuum()
    return _vectors_checked(spark, sf, store.vectors())


def _job_progress(spark, sf):
    root = shared_dir(spark, "progress")
    _run_job(spark, sf, root)
    rows = spark.read.parquet(f"{root}/progress")
    return rows.groupBy("query").agg(F.sum("num_input_rows").alias("input_rows"))


def _ingest(spark, sf):
    root = shared_dir(spark, "ingest")
    sent = messages(spark, sf, "json")
    files = _files(sent)
    _slices(sent, f"{root}/raw", range(3), files, "timestamp")
    session = streaming_session(spark)
    schemas = packaged_schemas()
    raw = _read(session, f"{root}/raw", MESSAGE_SCHEMA, files)
    query = jobs.start_ingest(raw, schemas, schemas[max(schemas)], f"{root}/decoded", f"{root}/checkpoints", "json", NOW_OR_NEVER)
    jobs.finish([query])
    return root


def _ingested_events(spark, sf):
    return plain(written_events(spark, f"{_ingest(spark, sf)}/decoded", EVENT_SCHEMA, streaming=False))


def _ingested_rejects(spark, sf):
    rows = spark.read.parquet(f"{_ingest(spark, sf)}/decoded").where("status = 'reject'")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def _registered(spark, path: str, versions) -> None:
    """Versions of the events' subject written to a contracts table."""
    schemas = packaged_schemas()
    rows = [(SUBJECT, v, v, schemas[v]) for v in versions]
    spark.createDataFrame(rows, "subject string, version int, schema_id int, schema string").coalesce(1).write.mode("append").parquet(path)


def _asked(spark, path: str):
    """The contracts as the table has them at the time of the call."""
    return lambda: writer_schemas(contracts_table(spark, path), SUBJECT)


def _replayed(spark, sf):
    """The second version is registered after the first of two micro-batches: what was sent under it before then is
    decoded from the kept rejects."""
    root = shared_dir(spark, "replayed")
    sent = messages(spark, sf, "json")
    files = _files(sent)
    session = streaming_session(spark)
    contracts = _asked(session, f"{root}/contracts")
    for part, version in ((0, 1), (1, 2)):
        _registered(spark, f"{root}/contracts", [version])
        _slices(sent, f"{root}/raw", [0] if part == 0 else [1, 2], files, "timestamp")
        raw = _read(session, f"{root}/raw", MESSAGE_SCHEMA, 2 * files)
        jobs.finish([jobs.start_refreshing_ingest(raw, contracts, f"{root}/decoded", f"{root}/checkpoints", "json", NOW_OR_NEVER)])
    first = written_events(spark, f"{root}/decoded", EVENT_SCHEMA, streaming=False)
    rejects = spark.read.schema("value binary, kafka_ts timestamp, schema_id int, reason string, status string").parquet(f"{root}/decoded")
    rejects = rejects.where("status = 'reject'").select("value", F.col("kafka_ts").alias("timestamp"), "schema_id", "reason")
    later = events_of(replayed(rejects, *contracts(), "json"))
    return plain(first.withColumn("replayed", F.lit(False)).unionByName(later.withColumn("replayed", F.lit(True))))


def _pipeline_vectors(spark, sf):
    """The whole job from framed messages to vectors by its one entry point."""
    root = shared_dir(spark, "whole")
    sent = messages(spark, sf, "json")
    files = _files(sent)
    _write_slice(sent, f"{root}/raw", 0, files)
    _registered(spark, f"{root}/contracts", [1, 2])
    session = _session(spark, sent)
    raw = _read(session, f"{root}/raw", MESSAGE_SCHEMA, files)
    jobs.run_pipeline(session, raw, _asked(session, f"{root}/contracts"), f"{root}/out", trigger=NOW_OR_NEVER, codec="json", now=at(JOB_NOW))
    return FeatureStore(spark, f"{root}/out/store").vectors().drop(*_VECTOR_DROPS)


def _publish(spark, sf):
    """Every message and every letter read back: what a record became, under which key, and its reason."""
    root = shared_dir(spark, "publish")
    texts = record_texts(spark, sf)
    files = _files(texts)
    _slices(texts, f"{root}/records", range(3), files, "timestamp")
    session = streaming_session(spark)
    records = _read(session, f"{root}/records", "value string, timestamp timestamp", files)
    schemas = packaged_schemas()
    jobs.finish([jobs.start_publish_files(records, schemas, 2, f"{root}/out", f"{root}/checkpoints", "json", NOW_OR_NEVER)])
    sent = decode_messages(read_published(spark, f"{root}/out", "messages"), schemas, schemas[2], "json")
    sent = sent.select(
        F.lit("messages").alias("written"), F.col("key").cast("string").alias("key"), "e.event_id", "e.amount",
        F.col("reason").alias("error"), "timestamp",
    )
    letters = read_letters(read_published(spark, f"{root}/out", "letters").withColumn("key", F.col("key").cast("string")))
    event = F.when(F.col("event").startswith("{"), F.get_json_object("event", "$.event_id"))
    letters = letters.select(
        F.lit("letters").alias("written"), "key", event.alias("event_id"), F.lit(None).cast("double").alias("amount"), "error", "timestamp"
    )
    return plain(sent.unionByName(letters))


def _lives(spark, sf):
    """Guards judged by a keyed state per user that expires, in three micro-batches."""
    root = shared_dir(spark, "lives")
    log = expiring_log(spark, sf).where("guard is not null")
    files = _files(log)
    _slices(log, f"{root}/log", range(3), files, "write_ts")
    stream = _read(streaming_session(spark), f"{root}/log", log.schema, files)
    marked = mark_lives_stream(stream, FORGET_SECONDS)
    jobs.finish([jobs.start(marked, "lives", to_files(f"{root}/marked"), f"{root}/checkpoints", NOW_OR_NEVER, "append")])
    return plain(spark.read.parquet(f"{root}/marked").select("user_id", "grp", "seq", "life", "accepted"))


def _state(spark, sf):
    """Rows in state after the job ended, read from the checkpoints beside what the last reports say."""
    root = shared_dir(spark, "state")
    _run_job(spark, sf, root)
    session = streaming_session(spark)
    reported = latest_progress(spark.read.parquet(f"{root}/progress")).select("query", F.col("state_rows").alias("reported"))
    held = [
        jobs.state_rows(session, f"{root}/checkpoints/window_{grp}").select(F.lit(f"window_{grp}").alias("query"), "operator_id", F.col("rows").alias("held"))
        for grp in SPECS if grp in ("5m", "1h")
    ]
    return reduce(DataFrame.unionByName, held).join(reported, "query")


QUERIES = {
    "stream_lives": _lives,
    "state_read_back": _state,
    "rejects_replayed": _replayed,
    "pipeline_vectors": _pipeline_vectors,
    "stream_windows_5m": _windows("5m"),
    "stream_windows_1h": _windows("1h"),
    "stream_late_5m": _late("5m"),
    "stream_late_1h": _late("1h"),
    "stream_job_vectors": _job_vectors,
    "stream_job_compacted": _job_compacted,
    "stream_job_progress": _job_progress,
    "stream_ingest_events": _ingested_events,
    "stream_ingest_rejects": _ingested_rejects,
    "stream_publish": _publish,
}


def _windows_sql(grp: str, **options) -> str:
    _, _, length, slide = SPECS[grp]
    return sql.with_(sql.EVENTS, sql.windows("feats", length, slide, **options)) + (
        "select * exclude (distinct_products, distinct_categories), true as distinct_close from feats"
    )


_WATERMARK = (
    "(product_id <> 'p00007' or {end} > (select make_timestamp(epoch_us(max(event_ts)) // 1000 * 1000) "
    "- interval 2 minute from ev where product_id <> 'p00007'))"
)

_FIELDS = [
    "event_count", "view_count", "cart_count", "purchase_count", "spend", "refund_amount", "avg_order_value",
    "cart_conversion", "last_event_ms", "window_end_ms",
]


def _job_windows(grp: str) -> str:
    """Per slice the newest window it touched, as far as events had arrived; then the fold over slices."""
    _, _, length, slide = SPECS[grp]
    parts, begin = [], "0001-01-01"
    for i, end in enumerate(SLICE_ENDS):
        until = f"event_ts < timestamp '{end}'" if end else "true"
        parts.append(f"ev_{grp}_{i} as (select * from ev where {until})")
        parts.append(sql.windows(f"w_{grp}_{i}", length, slide, source=f"ev_{grp}_{i}"))
        parts.append(f"""
last_{grp}_{i} as (
  select *, {i} as slice from w_{grp}_{i} where last_event_ms >= epoch_ms(timestamp '{begin}')
  qualify row_number() over (partition by user_id order by window_end desc) = 1
)""")
        begin = end
    union = " union all ".join(f"select * from last_{grp}_{i}" for i in range(len(SLICE_ENDS)))
    kept = ", ".join(f"arg_max({f}, slice) filter (where {f} is not null) as {f}_{grp}" for f in _FIELDS)
    return ",\n".join(parts) + f",\nstate_{grp} as (select user_id, {kept} from ({union}) group by user_id)"


# The profile keeps an older device where the newest event of a later slice has none.
_JOB_PROFILE = f"""
seen as (
  select *, case when event_ts < timestamp '{SLICE_ENDS[0]}' then 0 when event_ts < timestamp '{SLICE_ENDS[1]}' then 1 else 2 end as slice
  from ev
),
newest as (select * from seen qualify row_number() over (partition by user_id, slice order by event_ts desc) = 1),
state_profile as (
  select user_id, arg_max(event_type, slice) as last_event_type, arg_max(category, slice) as last_category,
         arg_max(product_id, slice) as last_product_id,
         arg_max(device, slice) filter (where device is not null) as last_device,
         max(epoch_us(event_ts) // 1000) as last_seen_ms
  from newest group by user_id
)"""
_JOB = sql.with_(sql.EVENTS, _job_windows("5m"), _job_windows("1h"), _JOB_PROFILE) + (
    "select *, true as close_5m, true as close_1h from state_profile join state_5m using (user_id) join state_1h using (user_id)"
)

def _last_window(grp: str) -> str:
    _, _, length, slide = SPECS[grp]
    shown = ", ".join(f"{f} as {f}_{grp}" for f in _FIELDS)
    return sql.windows(f"w_{grp}", length, slide) + f""",
last_{grp} as (
  select user_id, {shown} from w_{grp} qualify row_number() over (partition by user_id order by window_end desc) = 1
)"""


_DECODABLE = sql.EVENTS.replace("ev as (", "sent as (", 1) + """,
ev as (
  select * replace (make_timestamp((epoch_us(event_ts) // 1000) * 1000) as event_ts) from sent
  where product_id not in ('p00013', 'p00029', 'p00041', 'p00057', 'p00091')
)"""
_PIPELINE = sql.with_(_DECODABLE, sql.PROFILE, _last_window("5m"), _last_window("1h")) + (
    "select * from profile join last_5m using (user_id) join last_1h using (user_id)"
)
_REPLAYED = f"""
select d.*, d.device is not null and d.kafka_ts < timestamp '{SLICE_ENDS[0]}' as replayed from ({WIRE["decode_events_json"]}) d"""

def _open_windows(grp: str) -> str:
    """Windows that the last watermark leaves open: two minutes behind the newest event."""
    end = "(select make_timestamp(epoch_us(max(event_ts)) // 1000 * 1000) - interval 2 minute from ev)"
    return f"select 'window_{grp}' as query, cast(0 as bigint) as operator_id, count(*) as held, count(*) as reported from w_{grp} where window_end > {end}"


_STATE = sql.with_(sql.EVENTS, sql.windows("w_5m", *SPECS["5m"][2:]), sql.windows("w_1h", *SPECS["1h"][2:])) + (
    f"{_open_windows('5m')} union all {_open_windows('1h')}"
)

ORACLES = {
    "rejects_replayed": _REPLAYED,
    "pipeline_vectors": _PIPELINE,
    "stream_lives": LIVES_MARKED,
    "stream_windows_5m": _windows_sql("5m"),
    "stream_windows_1h": _windows_sql("1h"),
    "stream_late_5m": _windows_sql("5m", keep=_WATERMARK),
    "stream_late_1h": _windows_sql("1h", keep=_WATERMARK),
    "stream_job_vectors": _JOB,
    "stream_job_compacted": _JOB,
    "stream_job_progress": """
select unnest(['window_5m', 'window_1h', 'profile']) as query, count(*) as input_rows from events""",
    "stream_ingest_events": WIRE["decode_events"],
    "stream_ingest_rejects": WIRE["reject_reasons"],
    "stream_publish": sql.with_(sql.EVENTS, ERRORS) + """
select case when error is null then 'messages' else 'letters' end as written, case when error is null then user_id else l.key end as key,
       case when l.product_id <> 'p00029' then event_id end as event_id, case when error is null then amount end as amount,
       error, case when error is null then make_timestamp(epoch_us(timestamp) // 1000 * 1000) else timestamp end as timestamp
from letters l join ev using (event_id)""",
    "state_read_back": _STATE,
}
