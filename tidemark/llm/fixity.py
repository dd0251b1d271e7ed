"""Merkle fixity audit of web archive replicas. DataFrame functions only.

Leaves are digests of archive records; above them stand nodes over growing, ordered offset ranges of a file, one node
a file, and nodes over growing ranges of files up to one root. A node's digest covers its children's places and
digests in order. Two replicas are compared from the root: only children of nodes that differ are joined, level by
level, down to the records at fault. Ranges are cut by offset, not by count, so a lost record changes its own branch
and no other. A node has a bounded number of children, since a record takes at least its header's bytes.

Defined results: a record in one replica only is ``missing`` or ``extra``; null addresses and bodies are empty ones;
records without an id are filed by a digest of their content; repeated rows are records of their own; two empty
replicas have no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, text_or_empty, written_once
from tidemark.operators.ordered import running_before

#: Bits of the offset ranges within a file, bits by which ranges of files grow, and bits of the ids in one file.
RANGE_BITS = (14, 18, 22, 26, 30)
FILE_BITS = 6
RECORD_BITS = 9


def warc_record(url: Column, body: Column) -> Column:
    """A response record of the archive format as text: header, body and the two line ends behind it."""
    lines = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit(lines), url, F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def record_digest(record: Column) -> Column:
    return F.sha2(F.encode(record, "UTF-8"), 256)


def _parents(nodes: DataFrame, file: Column, place: Column) -> DataFrame:
    """Nodes over ``nodes`` (file, place, digest)."""
    child = F.struct("file", "place", "digest")
    joined = nodes.groupBy(file.alias("up_file"), place.alias("up_place")).agg(F.sort_array(F.collect_list(child)).alias("kids"))
    text = F.transform("kids", lambda k: F.concat_ws(":", k["file"].cast("string"), k["place"].cast("string"), k["digest"]))
    return joined.select(
        F.col("up_file").alias("file"), F.col("up_place").alias("place"), F.sha2(F.array_join(text, ","), 256).alias("digest")
    )


def levels(most_file: int) -> list[tuple[int, int]]:
    """(file bits, offset bits) dropped at each level above the records; 63 offset bits drop the offset."""
    out = [(0, b) for b in (*RANGE_BITS, 63)]
    bits = 0
    while most_file >> bits:
        bits += FILE_BITS
        out.append((bits, 63))
    return out


def _up(bits: tuple[int, int]) -> tuple[Column, Column]:
    return F.shiftright("file", bits[0]), F.shiftright("place", bits[1])


def merkle_tree(records: DataFrame, steps: list[tuple[int, int]], name: str) -> list[DataFrame]:
    """The tree of ``records`` (file, offset, length, digest) from records to root; each level a shared table.

    ``file`` and ``place`` of a node are cut to its range: shifted right by the bits of its level.
    """
    leaf = F.sha2(F.concat_ws(":", F.col("length").cast("string"), "digest"), 256)
    tree = [records.select("file", F.col("offset").alias("place"), leaf.alias("digest"))]
    # records at one place are one leaf, so that both replicas have at most one row to compare there
    same = tree[0].groupBy("file", "place").agg(F.array_join(F.sort_array(F.collect_list("digest")), ",").alias("digest"))
    tree = [written_once(same, f"{name}-0")]
    file_bits, range_bits = 0, 0
    for k, (f, r) in enumerate(steps, 1):
        file, place = _up((f - file_bits, min(63, r - range_bits)))
        tree.append(written_once(_parents(tree[-1], file, place), f"{name}-{k}"))
        file_bits, range_bits = f, r
    return tree


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where the digests differ or only one side has a node."""
    one = a.select("file", "place", F.col("digest").alias("a"))
    two = b.select("file", "place", F.col("digest").alias("b"))
    return one.join(two, ["file", "place"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "place")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records at fault: ``file, offset, status`` and the ``length`` and ``digest`` of either side.

    Both have ``file`` (0 or more), ``offset``, ``length`` and ``digest`` of each record.
    """
    most = primary.select("file").unionByName(replica.select("file")).agg(F.max("file")).first()[0] or 0
    steps = levels(most)
    ours, theirs = merkle_tree(primary, steps, "fixity-primary"), merkle_tree(replica, steps, "fixity-replica")
    wrong = _differing(ours[-1], theirs[-1])
    for k in range(len(steps) - 1, -1, -1):
        above, below = steps[k], steps[k - 1] if k else (0, 0)
        file, place = _up((above[0] - below[0], min(63, above[1] - below[1])))
        suspect = wrong.select(F.col("file").alias("f"), F.col("place").alias("p"))
        opened = [t[k].join(suspect, (file == F.col("f")) & (place == F.col("p")), "left_semi") for t in (ours, theirs)]
        wrong = written_once(_differing(*opened), f"fixity-wrong-{k}")
    at = wrong.withColumnRenamed("place", "offset")
    sides = [
        r.join(at, ["file", "offset"], "left_semi").select(
            "file", "offset", F.col("length").alias(f"{n}_length"), F.col("digest").alias(f"{n}_digest")
        )
        for r, n in ((primary, "primary"), (replica, "replica"))
    ]
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "extra")
    return sides[0].join(sides[1], ["file", "offset"], "full").withColumn("status", status.otherwise("changed"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as archive records of files of ``1 << RECORD_BITS`` ids, and of a replica with planted damage.

    By a checksum of the id, some records of the replica have another first character (1), are gone (2) or cut in
    half (3); the replica keeps the offsets of the primary's index.
    """
    url, body = text_or_empty("url"), text_or_empty("html")
    kind = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % 199
    damaged = F.when(kind == 1, F.concat(F.lit("~"), F.substr(body, F.lit(2)))).when(
        kind == 3, F.substr(body, F.lit(1), F.expr("length(coalesce(html, '')) div 2"))
    )
    one, two = warc_record(url, body), warc_record(url, damaged.otherwise(body))
    by_content = F.conv(F.substring(F.md5(F.concat(url, body)), 1, 9), 16, 10).cast("long")
    key = F.coalesce(F.abs("page_id"), by_content)
    rows = pages.select(
        "page_id",
        key.alias("key"),
        F.shiftright(key, RECORD_BITS).alias("file"),
        F.octet_length(one).cast("long").alias("length"),
        record_digest(one).alias("digest"),
        F.octet_length(two).cast("long").alias("replica_length"),
        record_digest(two).alias("replica_digest"),
        (kind == 2).alias("gone"),
    )
    # a frequent id fills a file with more rows than one task should window
    placed = running_before(rows.withColumn("place", F.struct("key", "digest")), ["file"], "place", "length", "offset", "sum")
    return written_once(placed.drop("place").withColumn("offset", F.coalesce("offset", F.lit(0))), "fixity-records")


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = page_records(read(spark, sf_dir, "pages"))
    replica = records.where(~F.col("gone")).select(
        "file", "offset", F.col("replica_length").alias("length"), F.col("replica_digest").alias("digest")
    )
    return audit(records.select("file", "offset", "length", "digest"), replica)


QUERIES = {"op3_merkle_fixity": op3_merkle_fixity}

ORACLES = {
    "op3_merkle_fixity": r"""
with p as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as body,
         cast('0x' || md5(coalesce(cast(page_id as varchar), ''))[1:8] as bigint) % 199 as kind
  from pages),
d as (
  select *, case kind when 1 then '~' || body[2:] when 3 then body[1:(length(body) // 2)] else body end as bad from p),
w as (
  select *, 'WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: ' || url || '\r\nContent-Length: ' as head from d),
r as (
  select kind, coalesce(abs(page_id), cast('0x' || md5(url || body)[1:9] as bigint)) as key,
         replace(head, '\r\n', chr(13) || chr(10)) || strlen(body) || repeat(chr(13) || chr(10), 2) || body
           || repeat(chr(13) || chr(10), 2) as one,
         replace(head, '\r\n', chr(13) || chr(10)) || strlen(bad) || repeat(chr(13) || chr(10), 2) || bad
           || repeat(chr(13) || chr(10), 2) as two
  from w),
l as (
  select kind, key, key >> 9 as file, strlen(one)::bigint as primary_length, sha256(one) as primary_digest,
         strlen(two)::bigint as l2, sha256(two) as d2 from r),
o as (
  select *, coalesce(sum(primary_length) over (
    partition by file order by key, primary_digest rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from l)
select file, "offset", primary_length, primary_digest,
       case when kind <> 2 then l2 end as replica_length, case when kind <> 2 then d2 end as replica_digest,
       case when kind = 2 then 'missing' else 'changed' end as status
from o where kind = 2 or primary_digest <> d2""",
}
