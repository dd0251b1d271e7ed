"""Removal of repeated byte strings across a corpus with sharded suffix arrays.

Every start of a string of ``SPAN`` bytes belongs to one anchor: the smallest hashed gram within that string. Equal
strings have equal anchor grams at equal places, so strings can only be equal within the starts of one gram, and a
gram that occurs once in the corpus needs no further look. What remains is sorted:

1. Tasks cut each text into segments, the starts of one anchor with the bytes behind them, and send grams and digests,
   not texts. Grams seen twice or more are kept; equal segments of a gram become one class with a count.
2. The distinct segments of grams with several classes are fetched from their texts, one text per class, and sharded
   by gram. A shard is sorted by induced sorting (``suffixes``); runs of suffixes whose permuted common prefixes
   reach ``SPAN`` are equal strings, and a string with two starts is repeated.
3. A gram with more than ``CLASSES`` classes is spread over several shards. Each gives every string of its array
   once, by digest, dealt into buckets whose number grows with the shards; strings that two shards gave are repeated
   as well.
4. Classes give their repeated starts back to all their documents, where covered bytes are merged and removed.

Equality is told by bytes within a shard and by 128-bit digests elsewhere: of whole segments, whose gram then may have
no other class and needs no sorting, and of single strings between the shards of a spread gram.

Defined results: null and empty texts are no bytes; a row repeated whole is another document, so its strings repeat;
ids may be null or shared, a row is found by id and text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches, text_or_empty, written_once
from tidemark.llm.suffixes import joined, permuted_prefixes, suffix_array

SPAN = 400
#: Bytes of an anchor gram, a power of two.
GRAM = 64
#: Bytes sorted in one array, and classes of one gram in one shard.
SHARD, CLASSES = 1 << 20, 2048
#: Starts of a text that are anchored in one step.
BLOCK = 1 << 22


def gram_hashes(raw):
    """A 64-bit hash of the ``GRAM`` bytes at each place, by doubling."""
    import numpy as np

    h, factor, step = raw.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while step < GRAM:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_least(values, width: int):
    """Least value of each window, from running minima of blocks in both directions."""
    import numpy as np

    blocks = np.append(values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, span: int) -> Iterator:
    """``first, last, gram`` arrays: starts ``first`` to ``last`` have the anchor gram with this hash."""
    import numpy as np

    low = np.uint64((1 << 24) - 1)
    for begin in range(0, len(text) - span + 1, BLOCK):
        h = gram_hashes(np.frombuffer(text[begin : begin + BLOCK + span - 1], np.uint8))
        least = window_least((h & ~low) | np.arange(len(h), dtype=np.uint64), span - GRAM + 1)  # leftmost of equal ones
        at = (least & low).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.append(0, cut)
        yield first + begin, np.append(cut - 1, len(at) - 1) + begin, h[at[first]]


def segments(docs: DataFrame, span: int) -> DataFrame:
    """``doc_id, own, first, last, gram, digest`` of each anchor; ``own`` tells texts of one id apart."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, firsts, lasts, grams, digests = [], [], [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    raw = text.encode()
                    for first, last, gram in anchors(raw, span):
                        rows.append(np.full(len(first), k))
                        firsts.append(first)
                        lasts.append(last)
                        grams.append(gram.view(np.int64))
                        digests += [xxhash.xxh3_128_digest(raw[a : b + span]) for a, b in zip(first.tolist(), last.tolist())]
                if not rows:
                    continue
                at = pa.array(np.concatenate(rows))
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0).take(at),
                        "own": part.column(1).take(at),
                        "first": pa.array(np.concatenate(firsts)),
                        "last": pa.array(np.concatenate(lasts)),
                        "gram": pa.array(np.concatenate(grams)),
                        "digest": pa.array(digests, pa.binary()),
                    }
                )

    schema = f"doc_id {id_type}, own long, first long, last long, gram long, digest binary"
    return docs.select("doc_id", "own", "text").mapInArrow(cut, schema)


def repeated_starts(rows: list[tuple[bytes, int]], span: int):
    """For distinct segments with their counts: a boolean array over the starts of each, and one over all suffixes of
    the joined text with the run each belongs to."""
    import numpy as np

    texts, counts = [r[0] for r in rows], np.array([r[1] for r in rows])
    t, symbols, begins = joined(texts)
    found = suffix_array(t, symbols, len(texts))
    prefix = permuted_prefixes(t, found, texts)
    run = np.empty(len(t), np.int64)
    run[found] = np.cumsum(prefix[found] < span)
    starts = [np.arange(b, b + len(x) - span + 1) for b, x in zip(begins, texts)]
    weights = np.zeros(len(t), np.int64)
    for s, n in zip(starts, counts):
        weights[s] = n
    total = np.bincount(run, weights=weights)
    return [total[run[s]] > 1 for s in starts], [run[s] for s in starts]


def _spans(repeated) -> list[int]:
    """First and last of each run of true places, one after the other."""
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False]))))
    return np.column_stack((edge[::2], edge[1::2] - 1)).ravel().tolist()


#: A string of a spread gram: its digest, and its class and place where it has no other in its shard (else -1).
STRING = [("string", "<u8", 2), ("digest", "<u8", 2), ("start", "<i4")]
#: String buckets for each shard of a spread gram.
BUCKETS = 4


def _sorted_shards(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows ``gram, digest, spans`` for classes; for spread grams rows ``gram, bucket, strings``, in which each
    string of the shard is packed once."""
    import numpy as np
    import xxhash

    names = ["gram", "digest", "spans", "bucket", "strings"]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary()]

    def done(held):
        repeated, runs = repeated_starts([(r["bytes"], r["n"]) for r in held], span)
        out, given, packed = [], set(), {}
        for r, again, run in zip(held, repeated, runs):
            if r["n"] > 1:
                again = np.ones(len(again), bool)
            if again.any():
                out.append((r["gram"], r["digest"], _spans(again), None, None))
            if r["shards"] > 1:
                strings = packed.setdefault((r["gram"], r["shards"]), [])
                for k, (a, at) in enumerate(zip(again.tolist(), run.tolist())):
                    if not a or at not in given:
                        given.add(at)
                        string = xxhash.xxh3_128_digest(r["bytes"][k : k + span])
                        strings.append(string + (bytes(16) if a else r["digest"]) + (-1 if a else k).to_bytes(4, "little", signed=True))
        for (gram, shards), strings in packed.items():
            table = np.frombuffer(b"".join(strings), STRING)
            bucket = (table["string"][:, 0] % np.uint64(shards * BUCKETS)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            for k, part in zip(found.tolist(), np.split(table[order], first[1:])):
                out.append((gram, None, None, k, part.tobytes()))
        columns = zip(*out) if out else [[]] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    held, size, last = [], 0, None
    for batch in batches:
        for r in batch.to_pylist():
            group = (r["gram"], r["salt"])
            if last is not None and (last["gram"], last["salt"]) == group and last["digest"] == r["digest"]:
                continue  # the same class from a repeated row
            if size >= SHARD and (last["gram"], last["salt"]) != group:
                yield done(held)
                held, size = [], 0
            held.append(r)
            size += len(r["bytes"]) + 1
            last = r
    if held:
        yield done(held)


def _across(group):
    """Starts whose strings several shards gave, of one bucket of a spread gram's strings."""
    import numpy as np
    import pandas as pd

    table = np.frombuffer(b"".join(group["strings"]), STRING)
    _, place, count = np.unique(table["string"], axis=0, return_inverse=True, return_counts=True)
    table = table[(count[place.ravel()] > 1) & (table["start"] >= 0)]
    digests, place = np.unique(table["digest"], axis=0, return_inverse=True)
    order = np.lexsort((table["start"], place.ravel()))
    starts = np.split(table["start"][order], np.cumsum(np.bincount(place.ravel()))[:-1])
    spans = pd.Series([np.repeat(s, 2).tolist() for s in starts[: len(digests)]], dtype=object)
    names = pd.Series([d.tobytes() for d in digests], dtype=object)
    return pd.DataFrame({"gram": np.full(len(names), group["gram"].iloc[0]), "digest": names, "spans": spans})


def repeated_classes(docs: DataFrame, twice: DataFrame, span: int) -> DataFrame:
    """``gram, digest, spans``: repeated starts of every class, relative to its first start."""
    classes = twice.groupBy("gram", "digest").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "own", "first", "last")]
    )
    classes = written_once(classes, "suffix-classes")
    many = written_once(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "suffix-many")
    shards = F.ceil(F.col("classes") / CLASSES)
    wanted = classes.join(many, "gram").select(
        "doc_id",
        "own",
        F.struct(
            "gram", "digest", "n", "first", "last",
            F.pmod(F.xxhash64("digest"), shards).cast("long").alias("salt"), shards.cast("long").alias("shards"),
        ).alias("piece"),
    )
    per_text = wanted.groupBy("doc_id", "own").agg(F.collect_list("piece").alias("pieces"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                cut = [{**p, "bytes": raw[p["first"] : p["last"] + span]} for p in pieces]
                yield pa.RecordBatch.from_pylist(cut, pa.schema([(n, t) for n, t in fields]))

    fields = [("gram", pa.int64()), ("salt", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("shards", pa.int64()), ("bytes", pa.binary())]
    schema = "gram long, salt long, digest binary, n long, shards long, bytes binary"
    p = per_text.select(F.col("doc_id").alias("p_id"), F.col("own").alias("p_own"), "pieces")
    on = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("own") == F.col("p_own"))
    fetched = docs.join(p, on).select("text", "pieces").mapInArrow(fetch, schema)
    dealt = fetched.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "digest")
    out = dealt.mapInArrow(lambda b: _sorted_shards(b, span), "gram long, digest binary, spans array<int>, bucket int, strings binary")
    out = written_once(out, "suffix-shards")

    strings = out.where("strings is not null").select("gram", "bucket", "strings")
    across = strings.groupBy("gram", "bucket").applyInPandas(_across, "gram long, digest binary, spans array<int>")
    single = classes.join(many, "gram", "left_anti").where("n > 1")
    return (
        out.where("strings is null").select("gram", "digest", "spans")
        .unionByName(across)
        .unionByName(single.select("gram", "digest", F.expr("array(0, cast(last - first as int))").alias("spans")))
    )


def covered(spans, span: int):
    """Maximal runs of covered bytes, first and behind last, of rows (first start, last start)."""
    import numpy as np

    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1] + span)
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    at = np.flatnonzero(new)
    return np.column_stack((spans[at, 0], ends[np.append(at[1:] - 1, len(spans) - 1)]))


def without_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row; kept has the bytes that stay."""
    text = text_or_empty(text_col)
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    found = written_once(segments(rows, span), "suffix-segments")
    # written, so that both sides of the join are shuffled for it and a frequent gram can be split
    grams = written_once(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-grams")
    twice = written_once(found.join(grams, "gram", "left_semi"), "suffix-twice")
    classes = written_once(repeated_classes(rows, twice, span), "suffix-repeated")
    per_text = twice.join(classes, ["gram", "digest"]).groupBy("doc_id", "own").agg(
        F.collect_set(F.struct("first", "spans")).alias("spans")
    )

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            raw = text.encode()
            if not own:
                out.append((len(raw), 0, 0, raw))
                continue
            at = [np.array(s["spans"], np.int64).reshape(-1, 2) + s["first"] for s in own]
            runs = covered(np.concatenate(at), span)
            stay = np.concatenate(([0], runs.ravel(), [len(raw)])).reshape(-1, 2).tolist()
            kept = b"".join(raw[a:b] for a, b in stay)
            out.append((len(raw), len(raw) - len(kept), len(runs), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = zip(*out) if out else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["n_bytes", "n_removed", "n_spans", "kept"])

    p = per_text.select(F.col("doc_id").alias("p_id"), F.col("own").alias("p_own"), "spans")
    on = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("own") == F.col("p_own"))
    return rows.join(p, on, "left").select("doc_id", cut("text", "spans").alias("cut")).select("doc_id", "cut.*")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and whether anything was removed (``removed``): ``n_bytes`` is the length of the whole
    text and says nothing about that."""
    cut = without_repeats(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", (F.col("n_removed") > 0).alias("removed"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
