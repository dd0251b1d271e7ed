"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. Of two fingerprints that differ in at most four bits, one
segment differs in at most one, so the two share a variant of it with that one bit left out. Every distinct
fingerprint is indexed under its 64 variants; equal variants meet and are verified on all 64 bits.

- Equal fingerprints are one row from the start, so exact copies cost nothing.
- Variants are range-partitioned by (variant, fingerprint): a variant that a third of all fingerprints share is
  spread over several partitions. Python holds ``SMALL`` rows of a variant, never all of them.
- Groups of at most ``SMALL`` fingerprints are compared in full, each pair reported at its first shared variant.
- Larger groups, and those a partition border may cut, are linked to a few of their members only, and listed. After
  components are known, the members outside the listed group's main component are joined with the whole group, so
  every pair in different components is looked at, and no pair within one is.

Defined results: null and wordless texts have fingerprint zero and link like any other; repeated rows and equal ids
each get a row; a component without any id has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep_rows, read, small_batches, text_or_empty, wrapped, written_once
from tidemark.llm.components import connected_components

WORDS = 4
MOST_BITS = 4
SEED = 42
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one variant that are compared in full, and members that stand for a larger group.
SMALL = 64
PIVOTS = 8


def fingerprint_of(text: str, words: int = WORDS, block: int = 1 << 16) -> int:
    """Majority bits of the shingles' XXH64, as an unsigned number."""
    import numpy as np
    import xxhash

    found = text.encode().lower().split()  # bytes: only A-Z change case, only ASCII space separates
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist()
    sums, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for begin in range(0, n, block):
        end = min(n, begin + block)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[begin:end], last[begin:end])), "<u8", end - begin)
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", **more: Column
) -> DataFrame:
    """``doc_id, fp`` and ``more``; fp has the 64 bits as a signed long."""

    @F.arrow_udf("bigint")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for texts in batches:
            found = np.array([fingerprint_of(t, words) for t in texts.to_pylist()], np.uint64)
            yield pa.array(found.view(np.int64), pa.int64())

    return small_batches(docs).select(
        F.col(id_col).alias("doc_id"), fingerprint(text_or_empty(text_col)).alias("fp"), *[c.alias(n) for n, c in more.items()]
    )


def variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: 64 rows for each fingerprint; key is the bit left out and its segment without that bit."""
    every = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    key = None
    for low, width in SEGMENTS:
        segment = f"shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L"
        rest = f"shiftleft(cast(bit as bigint), 22) | (({segment}) & ~shiftleft(1L, bit - {low}))"
        inside = (F.col("bit") >= low) & (F.col("bit") < low + width)
        key = F.when(inside, F.expr(rest)) if key is None else key.when(inside, F.expr(rest))
    return every.select(key.alias("key"), "fp")


def _bits(x):
    import numpy as np

    return np.bitwise_count(x)


def _first_shared(x):
    """The bit whose variant two fingerprints with difference ``x`` share first; -1 if they share none."""
    import numpy as np

    out = np.full(len(x), -1, np.int64)
    for low, width in reversed(SEGMENTS):
        part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        n = _bits(part)
        place = _bits(np.where(part == 0, np.uint64(0), part - np.uint64(1))).astype(np.int64)  # of a single set bit
        out = np.where(n <= 1, low + place, out)
    return out


def _group_links(key, fp, most: int):
    """Links of complete runs of equal keys: ``(a, b)`` of small ones in full, of larger ones to their first members;
    and the keys of the larger ones."""
    import numpy as np

    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    sizes, firsts = np.repeat(size, size), np.repeat(start, size)
    left = sizes - (np.arange(len(key)) - firsts) - 1  # members of the run behind this one
    a, b = [], []
    small = (sizes <= SMALL) & (left > 0)
    at, step = np.flatnonzero(small), 1
    while len(at):
        x = fp[at] ^ fp[at + step]
        hit = np.flatnonzero(_bits(x) <= most)
        hit = hit[_first_shared(x[hit]) == key[at[hit]] >> 22]
        a.append(fp[at[hit]])
        b.append(fp[at[hit] + step])
        step += 1
        at = at[left[at] >= step]
    big = np.flatnonzero(sizes > SMALL)
    for k in range(PIVOTS if len(big) else 0):
        pivot = fp[firsts[big] + k]
        hit = (_bits(fp[big] ^ pivot) <= most) & (fp[big] != pivot)
        a.append(fp[big[hit]])
        b.append(pivot[hit])
        big = big[~hit & (fp[big] != pivot)]
    return np.concatenate([*a, fp[:0]]), np.concatenate([*b, fp[:0]]), key[start[size > SMALL]]


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b`` are links; rows ``a, null`` are keys whose groups were not compared in full."""
    import numpy as np

    def out(a, b, listed):
        ends = pa.array(np.concatenate((b.view(np.int64), np.zeros(len(listed), np.int64))), pa.int64(), mask=np.arange(len(b) + len(listed)) >= len(b))
        return pa.record_batch({"a": pa.array(np.concatenate((a.view(np.int64), listed))), "b": ends})

    key, fp, cut = np.zeros(0, np.int64), np.zeros(0, np.uint64), None  # the open run; the key of which rows were let go
    border = True
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate((key, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
        if border:
            yield out(fp[:0], fp[:0], key[:1])  # the first run may have begun in another partition
            border = False
        last = int(np.searchsorted(key, key[-1]))
        yield out(*_group_links(key[:last], fp[:last], most))
        key, fp = key[last:], fp[last:]
        if len(key) > SMALL:
            yield out(*_group_links(key, fp, most))
            key, fp = key[: SMALL + 1], fp[: SMALL + 1]  # its first members stand for it
    if len(key):
        a, b, _ = _group_links(key, fp, most)
        yield out(a, b, key[:1])


def _across(listed: DataFrame, index: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Links between different components within the listed variants."""
    members = index.join(listed, "key").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    members = written_once(members.select("key", "fp", F.coalesce("label", "fp").alias("label")), "simhash-members")
    main = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    main = main.agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    outside = members.join(main, "key").where("label <> main").select("key", F.col("fp").alias("a"), F.col("label").alias("a_label"))
    near = (F.col("a_label") != F.col("label")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= most)
    return outside.alias("o").join(members.alias("m"), (F.col("o.key") == F.col("m.key")) & near).select("a", F.col("fp").alias("b"))


def linked(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``node, label`` of fingerprints that have links; ``fps`` has distinct fingerprints."""
    if most > 2 * len(SEGMENTS) - 1:
        raise ValueError("so many bits can leave every segment with two differing bits")
    index = variants(fps)
    sorted_index = index.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    found = written_once(sorted_index.mapInArrow(lambda batches: _links(batches, most), "a long, b long"), "simhash-links")
    edges, listed = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("key")).distinct()
    labels = written_once(connected_components(edges), "simhash-labels")
    more = written_once(_across(listed, index, labels, most), "simhash-across")
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return connected_components(stars.unionByName(more))


def simhash_groups(
    docs: DataFrame, words: int = WORDS, most: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = written_once(fingerprints(docs, words, id_col, text_col), "simhash-rows")
    per = written_once(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    labels = linked(per.select("fp"), most).withColumnRenamed("node", "fp")
    placed = per.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = written_once(placed.join(named, "label").select("fp", "component_id"), "simhash-known")
    return rows.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS) -> DataFrame:
    """One row of each group, with all its columns: the smallest id (null ids last), then the smallest text digest.

    Rows are picked back by id and text, so other groups' rows of a shared or null id are neither taken nor lost.
    """
    digest = F.sha2(F.encode(text_or_empty("text"), "UTF-8"), 256)
    rows = written_once(fingerprints(docs, words, digest=digest), "simhash-rows")
    each = rows.groupBy("fp", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")
    per = written_once(each.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    labels = linked(per.select("fp"), most).withColumnRenamed("node", "fp")
    placed = per.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    kept = placed.select(F.col("first.doc_id").alias("id"), "first.digest", (F.col("first.n") > 1).alias("repeated"))
    return keep_rows(wrapped(docs, id=F.col("doc_id"), digest=digest), written_once(kept, "simhash-kept"), ["id", "digest"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
