"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by nine concatenated random hashes (the nearest of 64 random directions
and their opposites) and compares every vector with the ``WINDOW`` behind it; pairs at or above the cosine are verified
in double precision. Verified pairs of all passes are united into components.

- The first hash parts the vectors; the others are taken of the difference to the part's mean, so that what a hot topic
  shares does not use up the key. The means come from a bounded sample and decide on nothing but the order.

- Copies of a vector are one node with a count from the start.
- A pass is one range shuffle by hash, streamed in sorted order with the window as the only state; the ends of
  neighbouring partitions meet in a second step, at most two windows at a time.
- Dense groups have more links than windows show, so links are counted after the components are known, without
  writing pairs: members within half the angle of their component's mean are all linked with each other (the angles
  add up), which takes a sum; only the members outside that core are compared with their component, in blocks of
  bounded rows. A component with many members outside its core costs their number times its size in block products.

A pair's chance to meet in one pass falls with its angle and with the number of vectors about as near to it as the
cosine; no pass is exact, so a lone pair can be missed (README has measured recall).

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors
of different lengths do not link; null ids are not candidates for a component's id, a component without ids has a null
id; repeated rows link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidemark.llm.common import read, small_batches, written_once
from tidemark.llm.components import connected_components

COSINE = 0.95
PASSES = 32
WINDOW = 256
SEED = 6
#: A key has ``LEVELS`` codes of 7 bits, each the nearest of 64 random directions and their opposites.
DIRECTIONS, LEVELS = 64, 9
#: Nodes, and bytes of them, from which the driver takes the centres that keys are relative to.
SAMPLE, SAMPLE_BYTES = 1 << 14, 32 << 20
#: Rows of one block of members outside the core, and of the members it is compared with.
BLOCK, SLICE = 512, 4096


def units(raw: list[bytes], dtype: str):
    """Rows of unit length in double precision; all of one length."""
    import numpy as np

    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, str]:
    """``vec_id, raw`` (null where the vector cannot link) and the number format of ``raw``."""
    kind = table.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    dtype = "<f4" if single else "<f8"

    @F.arrow_udf("binary")
    def raw(rows: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        values = rows.values.to_numpy(zero_copy_only=False).astype(dtype)  # null components become NaN
        bounds, gone = rows.offsets.to_numpy(), rows.is_null().to_numpy(zero_copy_only=False)
        for k in range(len(rows)):
            x = values[bounds[k] : bounds[k + 1]]
            out.append(x.tobytes() if not gone[k] and np.isfinite(x).all() and x.any() else None)
        return pa.array(out, pa.binary())

    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    return small_batches(table).select(F.col(id_col).alias("vec_id"), raw(vector).alias("raw")), dtype


def _planes(size: int, p: int, known: dict):
    """Directions of a pass, ``DIRECTIONS`` for each level; those of one level are orthogonal where the length allows it.
    ``known`` is the caller's own: a cache around this function would travel by name, not by value."""
    import numpy as np

    if (size, p) in known:
        return known[size, p]
    rng = np.random.default_rng([SEED, p, size])
    levels = [rng.standard_normal((size, DIRECTIONS)) for _ in range(LEVELS)]
    levels = [np.linalg.qr(a)[0] if size >= DIRECTIONS else a / np.sqrt((a * a).sum(axis=0)) for a in levels]
    known[size, p] = np.concatenate(levels, axis=1).astype(np.float32)
    return known[size, p]


def _codes(x, planes):
    """For each row and level the direction it is nearest to, of ``2 * DIRECTIONS`` with both signs."""
    import numpy as np

    y = (x @ planes).reshape(len(x), -1, DIRECTIONS)
    best = np.abs(y).argmax(axis=2)
    return 2 * best + (np.take_along_axis(y, best[:, :, None], 2)[:, :, 0] > 0)


def keys_of(x, p: int, centres=None, known: dict | None = None):
    """Keys of unit rows of one length in pass ``p``. The first level parts the rows, the others see what a row has
    beside the centre of its part: what a hot topic shares would give all its rows one key."""
    import numpy as np

    x, planes = x.astype(np.float32), _planes(x.shape[1], p, {} if known is None else known)
    key = _codes(x, planes[:, :DIRECTIONS])[:, 0]
    rest = _codes(x if centres is None else x - centres[key], planes[:, DIRECTIONS:])
    for level in range(LEVELS - 1):
        key = key * (2 * DIRECTIONS) + rest[:, level]
    return key.astype(np.int64)


def centres_of(x, p: int):
    """Means of the parts that the first level of pass ``p`` makes of unit rows; small parts count less."""
    import numpy as np

    x = x.astype(np.float32)
    key = _codes(x, _planes(x.shape[1], p, {})[:, :DIRECTIONS])[:, 0]
    sums = np.zeros((2 * DIRECTIONS, x.shape[1]), np.float32)
    np.add.at(sums, key, x)
    return sums / (np.bincount(key, minlength=2 * DIRECTIONS) + 16.0).astype(np.float32)[:, None]


def _centres(nodes: DataFrame, dtype: str, passes: int) -> dict:
    """Centres for each length and pass from nodes drawn by hash. They only order rows: no link depends on the draw
    but by the windows it makes."""
    import numpy as np

    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("bytes")).first()
    every = max(1, -(-size["n"] // SAMPLE), -(-(size["bytes"] or 0) // SAMPLE_BYTES))
    raw = sorted(bytes(r[0]) for r in nodes.where(F.pmod(F.xxhash64("raw"), F.lit(every)) == 0).select("raw").collect())
    sizes, out = np.array([len(r) for r in raw], np.int64), {}
    for width, n in zip(*np.unique(sizes, return_counts=True)):
        if n >= 4 * DIRECTIONS:
            x = units([raw[k] for k in np.flatnonzero(sizes == width)], dtype)
            out |= {(int(width), p): centres_of(x, p) for p in range(passes)}
    return out


def hashed(nodes: DataFrame, dtype: str, passes: int) -> DataFrame:
    """``pass, key, node, raw``: a row per pass; the pass number also tells vectors of different lengths apart."""
    shared = nodes.sparkSession.sparkContext.broadcast(_centres(nodes, dtype, passes))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known: dict = {}
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                x = units([raw[i] for i in at], dtype)
                for p in range(passes):
                    key = keys_of(x, p, shared.value.get((int(size), p)), known)
                    number = pa.array(np.full(len(at), int(size) * passes + p, np.int64))
                    yield pa.record_batch(
                        {"pass": number, "key": pa.array(key), "node": part.column(0), "raw": part.column(1)}
                    )

    return nodes.select("node", "raw").mapInArrow(keys, "pass long, key long, node long, raw binary")


def _near(number, node, raw: list[bytes], dtype: str, cosine: float, window: int, fresh: int):
    """Verified pairs of rows at most ``window`` apart in one pass, of which one is at ``fresh`` or behind."""
    import numpy as np

    a, b = [node[:0]], [node[:0]]
    for p in np.unique(number):
        at = np.flatnonzero(number == p)
        x, own = units([raw[i] for i in at], dtype), node[at]
        for begin in range(0, len(at), 512):
            i, j = np.nonzero(x[begin : begin + 512] @ x[begin : begin + 512 + window].T >= cosine)
            ok = (j > i) & (j <= i + window)
            i, j = i[ok] + begin, j[ok] + begin
            new = at[j] >= fresh
            i, j = _fewer(i[new], j[new], len(at))
            a.append(own[i])
            b.append(own[j])
    return np.concatenate(a), np.concatenate(b)


def _fewer(i, j, n: int):
    """Of links between rows i < j those that connect the same rows: one link back from each row makes trees, and of
    the others one for each two trees."""
    import numpy as np

    back = np.full(n, -1)
    np.maximum.at(back, j, i)
    root = np.where(back >= 0, back, np.arange(n))
    while (root[root] != root).any():
        root = root[root]
    tree = np.flatnonzero(back >= 0)
    apart = root[i] != root[j]
    _, first = np.unique(np.sort(np.column_stack((root[i[apart]], root[j[apart]])), axis=1), axis=0, return_index=True)
    return np.concatenate((back[tree], i[apart][first])), np.concatenate((tree, j[apart][first]))


def _pass_links(batches: Iterator[pa.RecordBatch], dtype: str, cosine: float, window: int) -> Iterator[pa.RecordBatch]:
    """Links within a sorted partition, and its first and last rows for the neighbouring partitions."""
    import numpy as np
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["a", "b", "border", "seq", "pass", "raw"]
    held, first, rows = None, None, 0

    def border(table, k, begin):
        n = table.num_rows
        return pa.record_batch(
            [table.column(2), pa.nulls(n, pa.int64()), pa.array([k] * n, pa.int64()),
             pa.array(range(begin, begin + n), pa.int64()), table.column(0), table.column(3)], names=names,
        )

    for batch in batches:
        for begin in range(0, batch.num_rows, 8192):
            piece = pa.Table.from_batches([batch.slice(begin, 8192)])
            fresh = held.num_rows if held is not None else 0
            held = (pa.concat_tables([held, piece]) if held is not None else piece).combine_chunks()
            if first is None or first.num_rows < window:
                first = held.slice(0, window) if rows <= window else first
            rows += piece.num_rows
            number, _, node, raw = (held.column(k) for k in range(4))
            a, b = _near(number.to_numpy(), node.to_numpy(), raw.to_pylist(), dtype, cosine, window, fresh)
            n = len(a)
            blank = pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array(a), pa.array(b), blank, blank, blank, pa.nulls(n, pa.binary())], names=names)
            held = held.slice(max(0, held.num_rows - window))
    if rows:
        # border k lies between partitions k and k + 1; rows keep their order by seq, the part before it negative
        yield from (border(b, part - 1, 0) for b in first.combine_chunks().to_batches())
        yield from (border(b, part, -held.num_rows) for b in held.combine_chunks().to_batches())


def linked(nodes: DataFrame, dtype: str, cosine: float, passes: int, window: int) -> DataFrame:
    """``a, b``: verified pairs of nodes from all passes."""
    ordered = hashed(nodes, dtype, passes).repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    schema = "a long, b long, border long, seq long, pass long, raw binary"
    found = written_once(ordered.mapInArrow(lambda bs: _pass_links(bs, dtype, cosine, window), schema), "vector-links")

    def meet(group):
        import pandas as pd

        group = group.sort_values("seq")
        behind = int((group["seq"] < 0).sum())
        a, b = _near(group["pass"].to_numpy(), group["a"].to_numpy(), list(group["raw"]), dtype, cosine, window, behind)
        return pd.DataFrame({"a": a, "b": b})

    within = found.where("border is null").select("a", "b")
    across = found.where("border is not null").groupBy("border").applyInPandas(meet, "a long, b long")
    return within.unionByName(across)


def _means(members: DataFrame, dtype: str) -> DataFrame:
    """``label, mean``: the sum of each component's unit vectors; tasks send one row per component."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            label = batch.column(0).to_numpy()
            found, place = np.unique(label, return_inverse=True)
            raw, sums = batch.column(1).to_pylist(), {}
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = units([raw[i] for i in at], dtype)
                total = np.zeros((len(found), x.shape[1]))
                np.add.at(total, place[at], x)
                for k in np.unique(place[at]):
                    sums[k] = total[k].tobytes()
            yield pa.record_batch({"label": pa.array(found), "mean": pa.array([sums[k] for k in range(len(found))], pa.binary())})

    def add(group):
        import numpy as np

        rows = np.frombuffer(b"".join(group["mean"]), np.float64).reshape(len(group), -1)
        return group.head(1).assign(mean=[rows.sum(axis=0).tobytes()])

    each = members.select("label", "raw").mapInArrow(partial, "label long, mean binary")
    return each.groupBy("label").applyInPandas(add, "label long, mean binary")


def link_counts(members: DataFrame, dtype: str, cosine: float) -> DataFrame:
    """``node, links``: copies of other nodes of the same component at or above the cosine.

    ``members`` has ``label, node, n, raw`` of nodes in components.
    """

    @F.arrow_udf("boolean")
    def inside(raw: pa.Array, mean: pa.Array) -> pa.Array:
        import numpy as np

        half = np.cos(np.arccos(cosine) / 2) + 1e-9
        pairs = zip(raw.to_pylist(), mean.to_pylist())
        near = (units([r], dtype)[0] @ units([m], "<f8")[0] if any(m) else -1 for r, m in pairs)
        return pa.array([bool(x >= half) for x in near])

    with_mean = members.join(_means(members, dtype), "label")
    flagged = written_once(with_mean.select("label", "node", "n", "raw", inside("raw", "mean").alias("core")), "vector-core")
    sizes = flagged.groupBy("label").agg(
        F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"),
        F.ceil(F.count_if(~F.col("core")) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"),
    )
    sized = flagged.join(sizes, "label")
    spread = F.xxhash64("node")
    outer = sized.where("blocks > 0")
    block, piece = F.pmod(spread, "blocks").cast("int"), F.pmod(spread, "slices").cast("int")
    columns = ["label", "node", "n", "raw", "core"]
    asked = outer.where("not core").select(
        *columns, block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("asks")
    )
    others = outer.select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), piece.alias("slice"), F.lit(False).alias("asks")
    )

    def count(group):
        import numpy as np
        import pandas as pd

        asks = group["asks"].to_numpy(bool)
        q, m = group[asks], group[~asks]
        if not len(q) or not len(m):
            return pd.DataFrame({"node": [], "links": []}, dtype=np.int64)
        near = units(list(q["raw"]), dtype) @ units(list(m["raw"]), dtype).T >= cosine
        near &= q["node"].to_numpy()[:, None] != m["node"].to_numpy()[None, :]
        to_m = q["n"].to_numpy() @ near
        to_q = near @ np.where(m["core"].to_numpy(bool), m["n"].to_numpy(), 0)
        return pd.DataFrame({"node": np.concatenate((q["node"], m["node"])), "links": np.concatenate((to_q, to_m))})

    outside = asked.unionByName(others).groupBy("label", "block", "slice").applyInPandas(count, "node long, links long")
    outside = outside.groupBy("node").agg(F.sum("links").alias("outside"))
    own = F.when(F.col("core"), F.col("core_n") - F.col("n")).otherwise(0)
    return sized.join(outside, "node", "left").select("node", (own + F.coalesce("outside", F.lit(0))).alias("links"))


def near_vectors(
    table: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows, dtype = vectors(table, id_col, vector_col)
    rows = written_once(rows, "vector-rows")
    nodes = rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    nodes = written_once(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    labels = written_once(connected_components(linked(nodes, dtype, cosine, passes, window)), "vector-labels")
    members = written_once(nodes.join(labels, "node").select("label", "node", "n", "raw"), "vector-members")
    links = link_counts(members, dtype, cosine)
    placed = nodes.join(labels, "node", "left").join(links, "node", "left")
    placed = written_once(
        placed.select("raw", "first_id", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "vector-placed",
    )
    named = placed.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = placed.join(named, "label").select("raw", "n_links", "component_id")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = rows.join(written_once(known, "vector-known"), "raw").select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op6_vector_dedup": op6_vector_dedup}
