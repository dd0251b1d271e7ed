"""Hard negatives by inner product with coordinate pruning over length buckets.

Vectors become integers and are packed into buckets of similar length, one row each; buckets are dealt into groups, and
every group meets the anchors in chunks, so neither all anchors nor all vectors are in one place.

Within a group, buckets are gone through from long to short. A bucket holds a sorted list of its unit vectors' values
for each coordinate. An anchor whose current bound is ``t`` (its fifth best score so far, over its own and the bucket's
greatest length) can only reach it with vectors at an angle of at most ``acos(t)``; that leaves a range of values for
each of its largest coordinates (the focus), which is looked up in the sorted lists. The shortest range gives the
candidates, the other ranges cut them down, and what is left is verified with exact integers. Ranges that hold much of
a bucket are verified as one block product. Bounds start from the anchors' own chunk.

The first round finds each anchor's positives; the second one, for each of them, the best vectors of other labels
within its share of the positive's score. Groups give their best few, and a window over these picks the best of all.

Defined results: rows with a null label or vector, or with a null or non-finite component take no part, and neither do
empty vectors and those whose squared integer length reaches 2 to the 63rd (their scores would not fit a long).
Vectors of different lengths never meet. A null id is never an anchor and comes last among ties; rows that repeat
whole are rows of their own, and an anchor that is there twice answers twice. An anchor without positives gives no
row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import read, small_batches, written_once

SCALE, POSITIVES, NEGATIVES, SHARE = 256, 5, 5, 80
#: Coordinates whose ranges are looked up for an anchor.
FOCUS = 4
#: Vectors in a bucket and in a group, anchors in a chunk and in one product.
BUCKET, GROUP, CHUNK, SLICE = 2048, 1 << 17, 1 << 14, 1024
#: Stands for a null id and comes behind all others.
NO_ID = (1 << 63) - 1
LOWEST = -(1 << 63)


def integers(table: DataFrame, anchor: Column, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, label, anchor, size, width, norm, raw`` of the rows that take part; raw has integers of ``width`` bytes."""

    @F.arrow_udf("struct<size: int, width: int, norm: double, raw: binary>")
    def scaled(rows: pa.Array) -> pa.Array:
        import numpy as np

        values = rows.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        bounds, gone = rows.offsets.to_numpy(), rows.is_null().to_numpy(zero_copy_only=False)
        out = []
        for k in range(len(rows)):
            x = values[bounds[k] : bounds[k + 1]]
            if gone[k] or not len(x) or not np.isfinite(x).all() or np.abs(x).max() * scale >= 2.0**32:
                out.append(None)
                continue
            c = np.floor(x * scale).astype(np.int64)
            square = sum(v * v for v in c.tolist()) if np.abs(c).max() >= 1 << 24 else int(c @ c)
            width = 2 if np.abs(c).max() < 1 << 15 else 8
            out.append((len(c), width, square**0.5, c.astype(f"<i{width}").tobytes()) if square < 1 << 63 else None)
        types = [pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        columns = zip(*[o or (None,) * 4 for o in out]) if out else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["size", "width", "norm", "raw"])

    rows = small_batches(table).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("vector"),
    )
    rows = rows.where("label is not null and vector is not null").withColumn("own", scaled("vector"))
    return rows.select("vec_id", "label", "anchor", "own.*").where("raw is not null")


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Buckets of sorted rows: one row with the lists of its vectors, all of one size and width and of similar length."""
    names = ["size", "width", "norm", "ids", "labels", "anchors", "raw"]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.binary()]
    held: list[tuple] = []

    def done():
        ids, labels, anchors, _, _, _, raw = zip(*held)
        first = held[0]
        row = [first[3], first[4], first[5], list(ids), list(labels), list(anchors), b"".join(raw)]
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (
                held[0][3:5] != row[3:5] or len(held) >= most or (len(held) >= most // 8 and row[5] < 0.9 * held[0][5])
            ):
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


class Bucket:
    """Vectors of a bucket row, and for each coordinate the sorted values of their unit vectors."""

    def __init__(self, row: dict):
        import numpy as np

        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        order = np.argsort(self.ids, kind="stable")  # equal scores then come in order of the ids
        self.ids, self.labels = self.ids[order], np.array(row["labels"], object)[order]
        self.rows = (np.arange(len(order)) + row["bucket"] * BUCKET)[order]
        self.vectors = np.frombuffer(row["raw"], f"<i{row['width']}").reshape(len(order), -1).astype(np.int64)[order]
        self.norm, self.sorted = row["norm"], None

    def lists(self):
        import numpy as np

        if self.sorted is None:
            x = self.vectors.astype(np.float64)
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            self.unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            self.order = np.argsort(self.unit, axis=0)
            self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        return self.sorted


class Anchors:
    """A chunk of anchors of one size, with their focus coordinates and current bounds."""

    def __init__(self, table: pa.Table):
        import numpy as np

        rows = table.to_pylist()
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.rows = np.array([r["row"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], object)
        self.vectors = np.array([np.frombuffer(r["raw"], f"<i{r['width']}") for r in rows]).astype(np.int64)
        x = self.vectors.astype(np.float64)
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.unit = np.divide(x, self.norms[:, None], out=np.zeros_like(x), where=self.norms[:, None] > 0)
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.bound = np.full(len(rows), LOWEST)
        self.top = float(self.norms.max(initial=0))


def _product(a, b, exact_in_doubles: bool):
    """Inner products of integer rows; doubles hold them exactly while the product of the lengths is below 2 to the 52nd."""
    import numpy as np

    return a.astype(np.float64) @ b.astype(np.float64).T if exact_in_doubles else a @ b.T


def candidates(own: Anchors, at, bucket: Bucket) -> Iterator[tuple]:
    """``anchors, columns, scores``: verified scores of all that may reach the bounds of anchors ``at``, and maybe more."""
    import numpy as np

    doubles = own.top * bucket.norm < 2.0**52
    bound = own.bound[at].astype(np.float64)
    reach = own.norms[at] * bucket.norm
    t = np.where(reach > 0, bound / np.where(reach > 0, reach, 1), np.where(bound > 0, 2.0, -1.0)) - 1e-9
    dense = at[t <= 0]
    at, t = at[(t > 0) & (t <= 1)], t[(t > 0) & (t <= 1)]
    if len(at):
        values, n = bucket.lists(), len(bucket.ids)
        angle = np.arccos(t)[:, None]
        focus = own.focus[at]
        own_angle = np.arccos(np.clip(np.take_along_axis(own.unit[at], focus, 1), -1, 1))
        low = np.cos(np.minimum(np.pi, own_angle + angle)) - 1e-9
        high = np.cos(np.maximum(0, own_angle - angle)) + 1e-9
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for c in np.unique(focus):
            here = focus == c
            first[here] = np.searchsorted(values[:, c], low[here], "left")
            last[here] = np.searchsorted(values[:, c], high[here], "right")
        count = last - first
        best = count.argmin(axis=1)
        least = count[np.arange(len(at)), best]
        few = np.flatnonzero((least > 0) & (least <= n // 8))
        for k in few.tolist():
            f = best[k]
            found = bucket.order[first[k, f] : last[k, f], focus[k, f]]
            for other in range(focus.shape[1]):
                if other != f:
                    x = bucket.unit[found, focus[k, other]]
                    found = found[(x >= low[k, other]) & (x <= high[k, other])]
            if len(found):
                found = np.sort(found)
                yield np.full(len(found), at[k]), found, bucket.vectors[found] @ own.vectors[at[k]]
        dense = np.concatenate((dense, at[least > n // 8]))
    for begin in range(0, len(dense), SLICE):
        some = np.sort(dense[begin : begin + SLICE])
        scores = _product(own.vectors[some], bucket.vectors, doubles)
        i, j = np.nonzero(scores >= own.bound[some][:, None])
        yield some[i], j, scores[i, j].astype(np.int64)


def best_rows(group, score, ids, rows, most: int):
    """Places of the best ``most`` of each group: by score, then id, then row; and the ordinal within the group."""
    import numpy as np

    order = np.lexsort((rows, ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    ordinal = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[ordinal < most], ordinal[ordinal < most]


def _kept(found: list[tuple], more: tuple, most: int):
    """The best rows of each group so far, with those of a further bucket; and the groups that are full with their last score."""
    import numpy as np

    columns = [np.concatenate(c) for c in zip(*found, more)]
    places, ordinal = best_rows(*columns, most)
    columns = [c[places] for c in columns]
    full = ordinal == most - 1
    return columns, columns[0][full], columns[1][full]


def _own_chunk(own: Anchors) -> Iterator[tuple]:
    """Scores among the anchors of a slice, which are vectors of the table as well."""
    import numpy as np

    for begin in range(0, len(own.ids), SLICE):
        at = np.arange(begin, min(begin + SLICE, len(own.ids)))
        yield at, _product(own.vectors[at], own.vectors[at], own.top**2 < 2.0**52)


def _positives(chunk: pa.Table, buckets: pa.Table, most: int) -> pa.Table:
    import numpy as np

    names = ["row", "positive_row", "positive_id", "positive_score"]
    if not chunk.num_rows or not buckets.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    own = Anchors(chunk)
    for at, scores in _own_chunk(own):
        same = (own.labels[at][:, None] == own.labels[at][None, :]) & ~np.eye(len(at), dtype=bool)
        if len(at) > most:
            least = np.partition(np.where(same, scores, LOWEST), -most, axis=1)[:, -most]
            own.bound[at] = np.where(same.sum(axis=1) >= most, least, LOWEST).astype(np.int64)
    none = np.zeros(0, np.int64)
    columns = [none] * 4
    for row in sorted(buckets.to_pylist(), key=lambda r: -r["norm"]):
        bucket = Bucket(row)
        for i, j, score in candidates(own, np.arange(len(own.ids)), bucket):
            ok = (own.labels[i] == bucket.labels[j]) & (own.rows[i] != bucket.rows[j]) & (score >= own.bound[i])
            i, j, score = i[ok], j[ok], score[ok]
            columns, full, least = _kept([tuple(columns)], (i, score, bucket.ids[j], bucket.rows[j]), most)
            own.bound[full] = np.maximum(own.bound[full], least)
    anchor, score, ids, rows = columns
    return pa.table({
        "row": pa.array(own.rows[anchor]), "positive_row": pa.array(rows), "positive_id": pa.array(ids, mask=ids == NO_ID), "positive_score": pa.array(score),
    })


def _negatives(chunk: pa.Table, buckets: pa.Table, most: int, share: int) -> pa.Table:
    import numpy as np

    if not chunk.num_rows or not buckets.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("row", "ordinal", "negative_row", "negative_id", "negative_score")})
    own = Anchors(chunk)
    tops = [list(r) for r in chunk.column("scores").to_pylist()]
    width = max(map(len, tops))
    high = np.array([t + [LOWEST] * (width - len(t)) for t in tops], np.int64)
    # the least score within the share; above the greatest one where there is none
    low = np.array([[-(-share * s // 100) if s >= 0 else NO_ID for s in t] + [NO_ID] * (width - len(t)) for t in tops], np.int64)
    bounds = low.copy()

    def tightened():
        # a bound of an anchor is what the easiest of its positives still asks for
        own.bound[:] = bounds.min(axis=1)

    for at, scores in _own_chunk(own):
        other = own.labels[at][:, None] != own.labels[at][None, :]
        for k in range(width if len(at) >= most else 0):
            inside = other & (scores >= low[at, k][:, None]) & (scores <= high[at, k][:, None])
            least = np.partition(np.where(inside, scores, LOWEST), -most, axis=1)[:, -most]
            full = inside.sum(axis=1) >= most
            bounds[at[full], k] = least[full].astype(np.int64)
    tightened()
    none = np.zeros(0, np.int64)
    columns = [none] * 4
    limit = high.max(axis=1)
    live = np.flatnonzero((low <= high).any(axis=1))
    for row in sorted(buckets.to_pylist(), key=lambda r: -r["norm"]):
        bucket = Bucket(row)
        for i, j, score in candidates(own, live, bucket):
            ok = (score >= own.bound[i]) & (score <= limit[i])
            ok[ok] = own.labels[i[ok]] != bucket.labels[j[ok]]
            i, j, score = i[ok], j[ok], score[ok]
            more = [columns]
            for k in range(width):
                fit = (score >= bounds[i, k]) & (score <= high[i, k])
                more.append((i[fit] * width + k, score[fit], bucket.ids[j[fit]], bucket.rows[j[fit]]))
            more = tuple(np.concatenate(c) for c in zip(*more[1:]))
            columns, full, least = _kept([tuple(columns)], more, most)
            bounds.ravel()[full] = np.maximum(bounds.ravel()[full], least)
        tightened()
    group, score, ids, rows = columns
    return pa.table({
        "row": pa.array(own.rows[group // width]), "ordinal": pa.array(group % width), "negative_row": pa.array(rows),
        "negative_id": pa.array(ids, mask=ids == NO_ID), "negative_score": pa.array(score),
    })


def hard_negatives(
    table: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE, bucket: int = BUCKET,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows where ``anchor`` holds. For each of an anchor's best ``positives`` rows of its label: the best
    ``negatives`` rows of other labels with ``share`` to 100 percent of the positive's score.
    """
    rows = integers(table, anchor, id_col, label_col, vector_col, scale).withColumn("n", F.monotonically_increasing_id())
    n = rows.count()
    # up to 64 groups share the work of small tables; beyond that a group holds GROUP rows
    groups = max(1, -(-n // GROUP), min(64, -(-n // 1024)))
    most = min(bucket, BUCKET, max(64, -(-n // (2 * groups))))
    ordered = rows.repartitionByRange("size", "width", F.desc("norm"), "n").sortWithinPartitions("size", "width", F.desc("norm"), "n").drop("n")
    schema = "size int, width int, norm double, ids array<long>, labels array<string>, anchors array<boolean>, raw binary"
    packed = ordered.mapInArrow(lambda b: _pack(b, most), schema).withColumn("bucket", F.monotonically_increasing_id())
    packed = written_once(packed, "negative-buckets")
    each = packed.where("exists(anchors, x -> x)").select(
        "size", "width", "bucket", "raw", F.posexplode(F.arrays_zip("ids", "labels", "anchors")).alias("k", "own")
    )
    anchors = each.where("own.anchors and own.ids is not null").select(
        (F.col("bucket") * BUCKET + F.col("k")).alias("row"), F.col("own.ids").alias("vec_id"), F.col("own.labels").alias("label"),
        "size", "width", F.expr("substring(raw, k * size * width + 1, size * width)").alias("raw"),
    )
    anchors = written_once(anchors, "negative-anchors")
    chunks = max(1, -(-anchors.count() // CHUNK))
    number = F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("int")
    dealt = packed.select("*", number.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).drop("anchors")

    def met(chunked: DataFrame, find, schema: str) -> DataFrame:
        copies = chunked.select(
            "*", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
        )
        keys = ["size", "group", "chunk"]
        return copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(find, schema)

    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    found = met(anchors, lambda a, b: _positives(a, b, positives), "row long, positive_row long, positive_id long, positive_score long")
    found = found.withColumn("ordinal", F.row_number().over(best) - 1).where(F.col("ordinal") < positives)
    found = written_once(found, "negative-positives")
    lists = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "positive_score"))), lambda x: x.positive_score).alias("scores"))
    asked = written_once(anchors.join(lists, "row"), "negative-asked")
    best = Window.partitionBy("row", "ordinal").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    near = met(asked, lambda a, b: _negatives(a, b, negatives, share), "row long, ordinal long, negative_row long, negative_id long, negative_score long")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = found.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return near.join(named, ["row", "ordinal"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(table, F.col("vec_id") % 100 == 0)


QUERIES = {"op11_negatives": op11_negatives}

ORACLES = {
    "op11_negatives": """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, b.label = a.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.row <> b.row WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
}
