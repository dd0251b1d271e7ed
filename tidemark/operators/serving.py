"""Reading feature vectors: single, bulk and sample lookups, and the latency of lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUEST_LIMIT = 1000  # fixed value: most ids one in-memory request may carry
RECENT_LOOKUPS = 500  # fixed value: lookups that serving statistics look back on


def _with_freshness(vectors: DataFrame, now: Column) -> DataFrame:
    return vectors.withColumn("freshness_ms", F.unix_millis(now) - F.col("last_seen_ms"))


def lookup(vectors: DataFrame, user_id: str, now: Column) -> DataFrame:
    """The vector of one user; no row means not found."""
    return _with_freshness(vectors.where(F.col("user_id") == user_id), now)


def lookup_batch(vectors: DataFrame, request: Sequence[str] | DataFrame, now: Column) -> DataFrame:
    """One row per requested id, duplicates kept, ``found`` false for unknown users; a Python request in its order.

    A Python request is limited in length and therefore safe to broadcast. A request table
    (``pos, user_id``) of any size is joined by shuffle; ids asked for very often are spread by the
    adaptive skew join, since the vector side has one row per id.
    """
    spark, asked = vectors.sparkSession, request
    if not isinstance(request, DataFrame):
        if not 1 <= len(request) <= REQUEST_LIMIT:
            raise ValueError(f"a request holds 1 to {REQUEST_LIMIT} ids; pass a table for more")
        ids = F.from_json(F.lit(_json_list(request)), "array<string>")
        request = spark.range(1).select(F.posexplode(ids).alias("pos", "user_id"))
        wanted = F.broadcast(request.select("user_id").distinct())
        vectors = vectors.join(wanted, "user_id", "left_semi")
    known = _with_freshness(vectors, now).withColumn("found", F.lit(True))
    answers = request.join(known, "user_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return answers if isinstance(asked, DataFrame) else answers.orderBy("pos")  # a table is not sorted whole


def _json_list(ids: Sequence[str]) -> str:
    import json

    return json.dumps(list(ids))


def with_window_age(vectors: DataFrame, now: Column, suffixes: Sequence[str] = ("_5m", "_1h")) -> DataFrame:
    """Age of each served window; a user who stopped sending events keeps their last window."""
    ages = {f"window_age_ms{s}": F.unix_millis(now) - F.col(f"window_end_ms{s}") for s in suffixes}
    return vectors.withColumns(ages)


def as_of(vectors: DataFrame, now: Column, suffixes: Sequence[str] = ("_5m", "_1h")) -> DataFrame:
    """Like the vectors, but fields of windows already closed at ``now`` read as null."""
    blanked = {}
    for suffix in suffixes:
        still_open = F.col(f"window_end_ms{suffix}") > F.unix_millis(now)
        for name in vectors.columns:
            if name.endswith(suffix):
                blanked[name] = F.when(still_open, F.col(name))
    return vectors.withColumns(blanked)


def sample_users(vectors: DataFrame, n: int = 8) -> DataFrame:
    """``n`` user ids that have features, in id order; repeatable because ids are picked by their hash."""
    if not 1 <= n <= 50:
        raise ValueError("n must be between 1 and 50")
    return vectors.select("user_id").orderBy(F.md5(F.col("user_id").cast("binary")), "user_id").limit(n).orderBy("user_id")


def lookup_log(answers: DataFrame) -> DataFrame:
    """Lookups that count for serving statistics: those that found a user."""
    return answers.where("found").select("user_id", "found", "latency_ms", "at")


def newest(rows: DataFrame, at: str, k: int, *tie_break: str) -> DataFrame:
    """The last ``k`` rows by time; a top-k that keeps k rows per task."""
    return rows.orderBy(F.col(at).desc_nulls_last(), *tie_break).limit(k)


#: Cells of an octave in the first round, and of an opened cell in the second.
OCTAVE, INNER = 64, 1 << 16
#: Doubles lie within this many octaves of one, on either side.
OCTAVES = 1100


def _outer_cell(value: Column, octave: int = OCTAVE) -> Column:
    """A whole number that never falls as the value grows: by sign and logarithm, some thousands of different ones for
    each cell of an octave at most."""
    v, most = value.cast("double"), 2 * OCTAVES * octave
    size = F.floor(F.log2(F.abs(v)) * octave) + most // 2
    finite = F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)
    edge = F.when(F.isnan(v), F.lit(most + 1)).when(v == float("inf"), F.lit(most)).when(v == -float("inf"), F.lit(-most))
    return F.coalesce(edge, finite).cast("bigint")


def _inner_cell(value: Column, low: Column, high: Column) -> Column:
    """The same within an opened cell: ``INNER`` steps between its least and greatest value."""
    v, low, high = (c.cast("double") for c in (value, low, high))
    step = F.floor((v - low) / (high - low) * INNER)
    return F.when(high > low, F.least(step, F.lit(INNER - 1))).otherwise(F.lit(0)).cast("bigint")


def _opened(cells: DataFrame, along: Window, ranks: Column) -> DataFrame:
    """Cells that hold a wanted rank, each with the ranks it holds as places within it."""
    first = F.coalesce(F.sum("rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("first", first).withColumn("ranks", ranks)
    inside = F.filter("ranks", lambda r: (r["at"] >= F.col("first")) & (r["at"] < F.col("first") + F.col("rows")))
    held = F.transform(inside, lambda r: F.struct(r["name"].alias("name"), (r["at"] - F.col("first")).alias("at")))
    return placed.withColumn("ranks", held).where(F.size("ranks") > 0).drop("first")


def order_statistics(
    rows: DataFrame, value: str, ranks: Callable[[Column], Mapping[str, Column]], octave: int = OCTAVE
) -> DataFrame:
    """One row: ``n`` and, by name, the values at ranks (from 0) that ``ranks`` gives for a row count; nulls do not count.

    Exact selection by histograms of ever finer cells, of which only those that hold a wanted rank are opened: counts by
    sign and logarithm over all rows, then steps between the extremes of an opened cell, then the distinct values of
    an opened step. Three scans; each row is sent as a map-side count of its cell, and rows of unopened cells are not
    sent again. The joined cells are as many as the ranks.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), _outer_cell(F.col(value), octave).alias("cell"))
    ends = [F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")]
    whole = Window.partitionBy()  # one row per cell
    outer = values.groupBy("cell").agg(*ends).withColumn("n", F.sum("rows").over(whole))
    wanted = {name: r.cast("bigint") for name, r in ranks(F.col("n")).items()}
    asked = F.array(*[F.struct(F.lit(name).alias("name"), at.alias("at")) for name, at in wanted.items()])
    outer = _opened(outer, whole.orderBy("cell"), asked).drop("rows")

    step = _inner_cell(F.col("v"), F.col("low"), F.col("high"))
    found = values.join(F.broadcast(outer), "cell").withColumn("step", step)
    inner = found.groupBy("cell", "step", "low", "high", "ranks", "n").agg(F.count(F.lit(1)).alias("rows"))
    inner = _opened(inner, Window.partitionBy("cell").orderBy("step"), F.col("ranks"))
    inner = inner.select("cell", "low", "high", F.col("step").alias("opened"), "ranks", "n")

    found = values.join(F.broadcast(inner), "cell").where(step == F.col("opened"))
    last = found.groupBy("cell", "opened", "v", "ranks", "n").agg(F.count(F.lit(1)).alias("rows"))
    last = _opened(last, Window.partitionBy("cell", "opened").orderBy("v"), F.col("ranks"))
    picks = [F.max(F.when(F.exists("ranks", lambda r: r["name"] == name), F.col("v"))).alias(name) for name in wanted]  # noqa: B023
    return last.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picks)


def _median_ranks(n: Column) -> dict[str, Column]:
    return {"below": F.floor((n - 1) / 2), "above": F.floor(n / 2)}


_MEDIAN = "(below + above) / 2"


def serving_latency(lookups: DataFrame, octave: int = OCTAVE) -> DataFrame:
    """Samples, median and p95 (rank ``floor(0.95 n)``, 0-based, at most the last), to 3 places."""
    found = order_statistics(
        lookups, "latency_ms", lambda n: {**_median_ranks(n), "p95": F.least(n - 1, F.floor(F.lit(0.95) * n))}, octave
    )
    return found.select(
        F.col("n").alias("samples"), F.round(F.expr(_MEDIAN), 3).alias("p50_ms"), F.round("p95", 3).alias("p95_ms")
    )


def benchmark_latency(lookups: DataFrame, octave: int = OCTAVE) -> DataFrame:
    """Lookups, median, p95 and p99 by rank ``round((n - 1) p / 100)`` (half to even), to 2 places."""

    def rank(n: Column, p: int) -> Column:
        return F.least(n - 1, F.bround((n - 1) * F.lit(float(p)) / 100).cast("bigint"))

    found = order_statistics(
        lookups, "latency_ms", lambda n: {**_median_ranks(n), "p95": rank(n, 95), "p99": rank(n, 99)}, octave
    )
    return found.select(
        F.col("n").alias("lookups"), F.round(F.expr(_MEDIAN), 2).alias("p50_ms"),
        F.round("p95", 2).alias("p95_ms"), F.round("p99", 2).alias("p99_ms"),
    )


def hit_rate(answers: DataFrame) -> DataFrame:
    return answers.agg(
        F.count(F.lit(1)).alias("lookups"), F.round(F.avg(F.col("found").cast("int")), 3).alias("hit_rate")
    )
