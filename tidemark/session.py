"""Session helpers shared by jobs, registered queries and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_utc(spark: SparkSession) -> SparkSession:
    """Event time is UTC everywhere; windows are aligned to the UTC epoch."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory below the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session, whose executors are
    this machine, may go without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and still there when executors are lost."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """Tasks that take at most ``most`` rows each on average; every core has one where that is worth its start."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, rows // 10_000))


def streaming_session(spark: SparkSession, shuffle_partitions: int | None = None, once: bool = False) -> SparkSession:
    """A session for streaming queries: UTC, RocksDB state, and its own shuffle width.

    The width is written into a checkpoint and cannot change afterwards, so it is chosen per job (the
    number of topic partitions or cores) and not taken from whatever the batch session uses.

    ``once`` is for queries that run through what is there and end: a state store is closed after each batch and loaded
    for the next one, so an executor holds the stores of its running tasks only, in memory and on its disk. Shuffles
    of a batch are removed with it.
    """
    session = use_utc(spark.newSession())
    state = "spark.sql.streaming.stateStore"
    session.conf.set("spark.sql.shuffle.partitions", shuffle_partitions or spark.sparkContext.defaultParallelism)
    session.conf.set(f"{state}.providerClass", ROCKSDB_STATE_STORE)
    session.conf.set(f"{state}.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set(f"{state}.rocksdb.allowFAllocate", "false")  # else every store takes 4 MB of disk in advance
    session.conf.set(f"{state}.compression.codec", "zstd")
    session.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if once:
        session.conf.set(f"{state}.unloadOnCommit", "true")
    return session
