"""What happens to each micro-batch. Every sink overwrites its own batch directory, so replays are harmless."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators.decode import decode_messages, encode_payload
from tidemark.operators.profiles import latest_profile
from tidemark.operators.validate import check_records, dead_letters, valid_events
from tidemark.operators.windows import select_current_windows
from tidemark.sources.feature_store import FeatureStore

Sink = Callable[[DataFrame, int], None]
#: Writer schemas by id, and the reader schema, as they are when it is called.
Contracts = Callable[[], tuple[Mapping[int, str], str]]


def window_sink(store: FeatureStore, grp: str, now: Column | None = None) -> Sink:
    """The current window of each user touched by the batch goes to the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else now
        rows = select_current_windows(batch, at).drop("window_start", "window_end")
        store.append(rows, grp, batch_id, at, "window_end_ms")

    return write


def profile_sink(store: FeatureStore, now: Column | None = None) -> Sink:
    """The newest event of each user in the batch goes to the store; only the guard judges lateness."""

    def write(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else now
        store.append(latest_profile(batch), "profile", batch_id, at, "last_seen_ms")

    return write


def to_files(path: str) -> Sink:
    """One directory per micro-batch."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def to_topic(topic: str, options: Mapping[str, str]) -> Sink:
    """Keyed messages; a replayed batch is sent again, which the guarded store absorbs."""

    def write(rows: DataFrame, batch_id: int) -> None:
        keyed = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        keyed.write.format("kafka").options(**{**options, "topic": topic}).save()

    return write


def contract_sink(schema: str, schema_id: int, messages: Sink, letters: Sink, codec: str = "avro_arrow") -> Sink:
    """Valid JSON records become framed messages, the others dead letters; the check runs once for both."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = check_records(batch, schema).persist()
        try:
            value = wire.frame(F.lit(schema_id), encode_payload(schema, codec))
            framed = valid_events(checked, schema).select(
                F.col("user_id").cast("binary").alias("key"), value.alias("value"), F.col("event_ts").alias("timestamp")
            )
            messages(framed, batch_id)
            letters(dead_letters(checked), batch_id)
        finally:
            checked.unpersist()

    return write


def ingest_rows(decoded: DataFrame) -> DataFrame:
    """Both outcomes of decoding as rows of one table, by ``status``: events, and rejects with their bytes and reason."""
    rejected = F.col("reason").isNotNull()
    return decoded.select(
        "e.*",
        F.col("timestamp").alias("kafka_ts"),
        F.when(rejected, F.col("value")).alias("value"),
        "schema_id",
        "reason",
        F.when(rejected, "reject").otherwise("event").alias("status"),
    )


def ingest_sink(contracts: Contracts, path: str, codec: str = "avro_arrow") -> Sink:
    """Decode each batch under the contracts that stand when it begins, into a directory of its own.

    The directory is written aside and renamed, so its files appear together; a replayed batch whose directory is there
    already is left alone, and what streams from the table sees every file once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
        aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_aside/{batch_id}")
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(target):
            return
        writers, reader = contracts()
        rows = ingest_rows(decode_messages(batch, writers, reader, codec))
        rows.write.mode("overwrite").partitionBy("status").parquet(str(aside))
        if not fs.rename(aside, target):
            raise OSError(f"could not rename {aside}")

    return write


def published_sink(schema: str, schema_id: int, path: str, codec: str = "avro_arrow") -> Sink:
    """Messages and dead letters of a batch in one write, by ``output``: the marker that Spark writes last stands for
    both, so no reader of :func:`read_published` sees one without the other, and a replayed batch replaces both."""

    def write(batch: DataFrame, batch_id: int) -> None:
        outputs: dict[str, DataFrame] = {}

        def hold(output: str) -> Sink:
            return lambda rows, _: outputs.update({output: rows})

        def both(rows: DataFrame, _: int) -> None:
            hold("letters")(rows, _)
            parts = [
                r.select(F.lit(o).alias("output"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "timestamp")
                for o, r in outputs.items()
            ]
            parts[0].unionByName(parts[1]).write.mode("overwrite").partitionBy("output").parquet(f"{path}/batch_id={batch_id}")

        contract_sink(schema, schema_id, hold("messages"), both, codec)(batch, batch_id)

    return write


def read_published(spark: SparkSession, path: str, output: str) -> DataFrame:
    """``key, value, timestamp`` of one output (``messages`` or ``letters``), of batches written to their end."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/_SUCCESS")
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(status.getPath().getParent()) for status in fs.globStatus(found) or []]
    schema = "key binary, value binary, timestamp timestamp, output string"
    rows = spark.read.schema(schema).option("basePath", path).parquet(*done) if done else spark.createDataFrame([], schema)
    return rows.where(F.col("output") == output).select("key", "value", "timestamp")
