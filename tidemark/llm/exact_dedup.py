"""Exact dedup over a persistent digest index, bucketed and sorted by digest. DataFrame functions only.

New rows are reduced to one candidate for each digest (partial aggregates run before the shuffle, so a text that
makes up a third of all rows sends one row per task), anti-joined by sort-merge against the index, and appended to
it. The index stores what stayed, never texts.

Defined results: null text counts as empty; null ids come after all others; of rows repeated whole (same id, same
text) one is kept; an empty table gives an empty result and appends nothing. Extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep_rows, read, shared_dir, text_or_empty, wrapped, written_once

#: Characters that do not count when texts are compared.
IGNORED = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text_or_empty(text), IGNORED, "")


def digest(text: str | Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def points(text: str | Column) -> Column:
    return F.length(text_or_empty(text)).cast("long")


def spaced(text: str | Column) -> Column:
    """A hash of the text with its white space, to tell texts of one digest apart."""
    return F.xxhash64(text_or_empty(text))


class DigestIndex:
    """A table of digests below ``path``: one row for each text seen, in ``buckets`` sorted buckets.

    The folder outlives the session; a new session registers it again under the same name. The number of buckets
    belongs to the folder and has to stay what it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"create table if not exists {self.table} (digest string, keep_id {id_type}, points bigint, batch string) using parquet "
            f"clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def absent(self, candidates: DataFrame) -> DataFrame:
        """Candidates whose digest the index lacks; the index side is read in its buckets, not shuffled."""
        return candidates.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """One sorted file for each bucket and append; ``batch`` names the call that brought the rows."""
        fresh.select("digest", "keep_id", "points", F.lit(batch)).repartition(self.buckets, "digest").write.insertInto(self.table)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, digest, length in code points, hash with white space and a number for each row; written once, so the numbers
    stay."""
    small = docs.select(
        F.col(id_col).alias("doc_id"),
        digest(text_col).alias("digest"),
        points(text_col).alias("points"),
        spaced(text_col).alias("spaced"),
    )
    return written_once(small.withColumn("row", F.monotonically_increasing_id()), "digests")


def candidates(rows: DataFrame) -> DataFrame:
    """For each digest the row to keep (most code points, then smallest id, then by content) and the group's size."""
    order = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "spaced", "row")
    best = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select(
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.less")).alias("points"),
        F.col("best.row").alias("keep_row"),
        "group_size",
    )


def judged_rows(
    docs: DataFrame, index_path: str | None = None, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """``exact_dedup`` with ``points`` and ``spaced`` of each row."""
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col)
    index = DigestIndex(
        spark, index_path or shared_dir(spark, "digest-index"), buckets, rows.schema["doc_id"].dataType.simpleString()
    )
    batch = batch or uuid.uuid4().hex
    best = candidates(rows)
    fresh = written_once(index.absent(best), "digest-fresh")
    index.append(fresh, batch)
    judged = written_once(
        best.select("digest", "keep_row", "group_size").join(index.rows().drop("points"), "digest"), "digest-judged"
    )
    return rows.join(judged, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "points",
        "spaced",
    )


def exact_dedup(
    docs: DataFrame, index_path: str | None = None, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """Judge new rows against the index at ``index_path`` and among themselves, and append what is new to it.

    One row for each input row: ``doc_id, keep_id`` (the indexed row where the text was known before, else the
    row of this batch that stays), ``group_size`` (rows of this batch with that text), ``kept``, ``text_sha256``.
    Without ``index_path`` a new index is laid out in the shared folder. ``batch`` names these rows in the index: run
    again under the same name, after a driver was lost, they are judged as the first time. Without a name a second
    call finds its own texts as known before.
    """
    return judged_rows(docs, index_path, buckets, id_col, text_col, batch).drop("points", "spaced")


def drop_copies(
    docs: DataFrame, index_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one id, they are told apart by their text."""
    kept = judged_rows(docs, index_path, id_col=id_col, text_col=text_col, batch=batch)
    ids = kept.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), "points", "spaced").agg(
        F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("repeated")
    )
    rows = wrapped(docs, id=F.col(id_col), digest=digest(text_col), points=points(text_col), spaced=spaced(text_col))
    return keep_rows(rows, ids.where("kept"), ["id", "digest", "points", "spaced"])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLES = {
    "op7_exact_dedup": r"""
with d as (
  select doc_id, coalesce(text, '') as body,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
w as (
  select *, first_value(doc_id) over (g order by length(body) desc, doc_id nulls last) as keep_id,
         count(*) over g as group_size,
         row_number() over (g order by length(body) desc, doc_id nulls last) as rn
  from d window g as (partition by text_sha256))
select doc_id, keep_id, group_size, rn = 1 as kept, text_sha256 from w""",
}
