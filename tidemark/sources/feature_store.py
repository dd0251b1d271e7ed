"""The feature store on files: an append-only log per group, folded snapshots, and a manifest.

Layout below one root::

    log/grp=5m/batch_id=17/bucket=9    rows written by micro-batch 17 (a replay overwrites its directory)
    snapshot/version=3/grp=5m/bucket=9 one row per user, everything folded up to the manifest's batch
    manifest/version=3/                last folded batch per group, bucket count and null rule of the store;
                                       written last, so it publishes version 3

A batch counts once its folder holds the marker that Spark writes last. Compaction stops before the first batch
without one, so a batch in flight is folded by a later compaction, and vacuum deletes only what was folded.

A batch is dealt by bucket before it is written, so its files are as many as its buckets and its size ask for,
whatever the number of tasks before. A lookup prunes to its users' buckets, in snapshots and in the log, and Parquet's
bloom filters on ``user_id``, sized by the users there are, skip the row groups of the files that are left. A user has
one row per batch, which bounds what a fold holds of one user.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import GUARDS, feature_columns, fold_log, log_vectors, to_log

# A filter of a fixed size would take a megabyte in every file; of these 16, each half the one before it,
# the smallest that holds the users of a row group is written.
BLOOM = {
    "parquet.bloom.filter.enabled#user_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.candidates.number#user_id": "16",
}


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, on_null: str = "keep",
                 rows_per_file: int = 2_000_000):
        self.spark = spark
        self.root = root.rstrip("/")
        # a store that was published keeps the bucket count and null rule it was published with
        stored = self._settings()
        self.buckets, self.on_null = stored if stored else (buckets, on_null)
        self.rows_per_file = rows_per_file

    # -- files

    def _path(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        jpath, fs = self._path(path)
        return fs.exists(jpath)

    def _children(self, path: str) -> list[str]:
        jpath, fs = self._path(path)
        return [status.getPath().getName() for status in fs.listStatus(jpath)] if fs.exists(jpath) else []

    def _manifests(self) -> DataFrame | None:
        path = f"{self.root}/manifest"
        if not self._exists(path):
            return None
        schema = "grp string, last_batch bigint, buckets int, on_null string, version int"
        return self.spark.read.schema(schema).parquet(path)

    def _settings(self) -> tuple[int, str] | None:
        rows = self._manifests()
        newest = None if rows is None else rows.where("buckets is not null").orderBy(F.desc("version")).first()
        return (newest["buckets"], newest["on_null"]) if newest else None

    def _bucket(self, user_id: Column) -> Column:
        return F.pmod(F.xxhash64(user_id), F.lit(self.buckets)).cast("int")

    # -- writing

    def append(self, rows: DataFrame, grp: str, batch_id: int, now: Column, guard: str | None = None) -> None:
        """Write one micro-batch (one row per user) of a group. Writing the same batch again changes nothing."""
        log = to_log(rows, grp, batch_id, guard or GUARDS.get(grp, "window_end_ms"), now).drop("grp")
        (
            log.withColumn("bucket", self._bucket(F.col("user_id")))
            .repartition("bucket")  # the sinks of stateful streams run without adaptive execution, which drops the hint
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", "user_id")
            .write.mode("overwrite")
            .option("maxRecordsPerFile", self.rows_per_file)
            .options(**BLOOM)
            .partitionBy("bucket")
            .parquet(f"{self.root}/log/grp={grp}/batch_id={batch_id}")
        )

    # -- reading

    def groups(self) -> list[str]:
        names = self._children(f"{self.root}/log")
        return sorted(n.removeprefix("grp=") for n in names if n.startswith("grp="))

    def _batch_ids(self, grp: str, pattern: str) -> set[int]:
        jpath, fs = self._path(f"{self.root}/log/grp={grp}/{pattern}")
        paths = [str(status.getPath()) for status in fs.globStatus(jpath) or []]
        return {int(p.split("/batch_id=")[1].split("/")[0]) for p in paths}

    def batches(self, grp: str, after: int = -1) -> list[int]:
        """Ids of the batches that were written to their end."""
        return sorted(i for i in self._batch_ids(grp, "batch_id=*/_SUCCESS") if i > after)

    def foldable(self, grp: str, after: int = -1) -> list[int]:
        """The batches before the first one that is still being written: only these may be published."""
        done = self.batches(grp, after)
        in_flight = self._batch_ids(grp, "batch_id=*") - set(done)
        first = min((i for i in in_flight if i > after), default=None)
        return done if first is None else [i for i in done if i < first]

    def _wanted(self, rows: DataFrame, users: Sequence[str] | None, bucket: int | None) -> DataFrame:
        """Rows of the named users or of one bucket; both are conditions on the partitioning ``bucket``."""
        if bucket is not None:
            rows = rows.where(F.col("bucket") == bucket)
        if users is not None:
            named = [self._bucket(F.lit(u)) for u in users]  # folded to constants: prunes bucket directories
            rows = rows.where(F.col("bucket").isin(*named) & F.col("user_id").isin(*users))
        return rows.drop("bucket")

    def log(self, grp: str, batches: Sequence[int], users: Sequence[str] | None = None, bucket: int | None = None) -> DataFrame:
        """Log rows of the named batches; no other batch directory is listed or read."""
        base = f"{self.root}/log/grp={grp}"
        rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/batch_id={i}" for i in batches])
        return self._wanted(rows, users, bucket).drop("batch_id").withColumn("grp", F.lit(grp))

    def manifest(self) -> tuple[int, dict[str, int]]:
        """Published snapshot version (0 if none) and the last folded batch per group."""
        rows = self._manifests()
        if rows is None:
            return 0, {}
        newest = rows.groupBy("grp").agg(F.max_by(F.struct("version", "last_batch"), "version").alias("m"))
        found = newest.select("grp", "m.*").collect()  # one row per feature group
        return max(r.version for r in found), {r.grp: r.last_batch for r in found}

    def snapshot(self, grp: str, version: int, users: Sequence[str] | None = None, bucket: int | None = None) -> DataFrame:
        table = self.spark.read.parquet(f"{self.root}/snapshot/version={version}/grp={grp}")
        return self._wanted(table, users, bucket).withColumn("grp", F.lit(grp))

    def rows(self, grp: str, users: Sequence[str] | None = None, bucket: int | None = None) -> DataFrame | None:
        """What a group's state is folded from: the published snapshot and the later batches."""
        version, folded = self.manifest()
        parts = [self.snapshot(grp, version, users, bucket)] if grp in folded else []
        if batches := self.batches(grp, folded.get(grp, -1)):
            parts.append(self.log(grp, batches, users, bucket))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def fold(self, grp: str, users: Sequence[str] | None = None, bucket: int | None = None) -> DataFrame | None:
        """Current state of a group: the published snapshot with later batches folded in."""
        rows = self.rows(grp, users, bucket)
        return None if rows is None else fold_log(rows, self.on_null, parts=None)

    def vectors(self, users: Sequence[str] | None = None) -> DataFrame:
        """One row per user with the fields of all groups, from one fold over the rows of all of them."""
        found = {g: r for g in self.groups() if (r := self.rows(g, users)) is not None}
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found.values())
        return log_vectors(union, {g: feature_columns(r) for g, r in found.items()}, self.on_null, parts=None)

    # -- compaction

    def compact(self) -> int:
        """Fold everything written so far into a new snapshot version and publish it."""
        version, folded = self.manifest()
        marks = []
        for grp in self.groups():
            batches = self.foldable(grp, folded.get(grp, -1))
            parts = [self.snapshot(grp, version)] if grp in folded else []
            parts += [self.log(grp, batches)] if batches else []
            if not parts:
                continue
            union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            state = fold_log(union, self.on_null, parts=None)
            (
                state.drop("grp")
                .withColumn("bucket", self._bucket(F.col("user_id")))
                .repartition(self.buckets, "bucket")
                .sortWithinPartitions("bucket", "user_id")
                .write.mode("overwrite")
                .option("maxRecordsPerFile", self.rows_per_file)
                .options(**BLOOM)
                .partitionBy("bucket")
                .parquet(f"{self.root}/snapshot/version={version + 1}/grp={grp}")
            )
            marks.append((grp, batches[-1] if batches else folded[grp], self.buckets, self.on_null))
        if not marks:
            return version
        marked = self.spark.createDataFrame(marks, "grp string, last_batch bigint, buckets int, on_null string").coalesce(1)
        marked.write.mode("overwrite").parquet(f"{self.root}/manifest/version={version + 1}")
        return version + 1

    def vacuum(self) -> int:
        """Delete log batches that the published snapshot holds, and snapshots older than the one before it."""
        version, folded = self.manifest()
        removed = 0
        for grp, last in folded.items():
            removed += self._delete_children(f"{self.root}/log/grp={grp}", "batch_id=", last)
        removed += self._delete_children(f"{self.root}/snapshot", "version=", version - 2)
        return removed

    def _delete_children(self, path: str, prefix: str, upto: int) -> int:
        removed = 0
        for name in self._children(path):
            if name.startswith(prefix) and int(name.removeprefix(prefix)) <= upto:
                jpath, fs = self._path(f"{path}/{name}")
                removed += bool(fs.delete(jpath, True))
        return removed
