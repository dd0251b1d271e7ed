"""Running values over long ordered groups without putting a whole group into one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import tasks_for, written_once

#: As many parts as the session shuffles into.
PARTS = 0
ROWS = 500_000  # rows that one task puts in order
FOLDS: dict[str, Callable[[str], Column]] = {"max": F.max, "sum": F.sum}


def in_order(df: DataFrame, by: Sequence[str], parts: int = PARTS) -> DataFrame:
    """The rows in parts of about equal row counts along ``by``, with the part's number as ``_part``.

    Range partitioning draws its borders from the rows themselves, so a group of many rows is cut into as many parts
    as its rows need, however its orders are spread. The parts are written, in the shared folder: borders drawn twice
    could differ. This runs jobs at once.
    """
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return written_once(ranged.withColumn("_part", F.spark_partition_id()), "in-order")


def _carried(placed: DataFrame, keys: list[str], value: str, fold: Callable[[str], Column]) -> DataFrame:
    """``_to, _key, _far``: what the first group of a part brings along from the parts before it; at most one row a part."""
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    along = Window.orderBy("_part")  # one row per part
    after = ends.select(
        F.col("_part").alias("_from"), F.lead("_part").over(along).alias("_to"), F.col("last").alias("_key"),
        F.lead("first").over(along).eqNullSafe(F.col("last")).alias("open"),
    ).where("open and _to is not null").drop("open")
    inside = placed.join(F.broadcast(after), (F.col("_part") == F.col("_from")) & key.eqNullSafe(F.col("_key")))
    totals = inside.groupBy("_from").agg(fold(value).alias("total"))
    upto = Window.partitionBy("_key").orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
    return after.join(totals, "_from").select("_to", "_key", fold("total").over(upto).alias("_far"))


def running_over(placed: DataFrame, keys: list[str], order: str, value: str, out: str, how: str = "max") -> DataFrame:
    """``running_before`` for rows of :func:`in_order`, which keep their ``_part``. As they are files, counting them reads
    no rows; the groups within parts are dealt to as many tasks as there are rows for."""
    fold = FOLDS[how]
    tasks = tasks_for(placed.sparkSession, placed.count(), ROWS)
    near = Window.partitionBy("_part", *keys).orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1)
    carried = written_once(_carried(placed, keys, value, fold), "carried")
    dealt = placed.repartition(tasks, "_part", *keys)
    joined = dealt.withColumn("_near", fold(value).over(near)).join(F.broadcast(carried), F.col("_part") == F.col("_to"), "left")
    far = F.when(F.struct(*keys).eqNullSafe(F.col("_key")), F.col("_far"))
    if how == "max":
        total = F.greatest("_near", far)
    else:
        total = F.when(F.col("_near").isNotNull() | far.isNotNull(), F.coalesce("_near", F.lit(0)) + F.coalesce(far, F.lit(0)))
    return joined.withColumn(out, total).select(*placed.columns, out)


def running_before(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, how: str = "max", parts: int | None = PARTS
) -> DataFrame:
    """Add ``out``: the max (or sum) of ``value`` over all rows that precede a row in its group.

    ``order`` is unique per group; equal orders are taken in order of ``value``.

    A plain window would sort a whole group in one task. Here rows are range partitioned along (group, order), windowed
    within the parts, and each part gets one carried row: the value of the group it starts in the middle of. The rows
    are read once and written in parts (see :func:`in_order`); joins only meet the carried rows, one per part and
    therefore broadcast. ``parts=None`` uses the plain window; choose it only where the group size has a known bound.
    """
    if parts is None:
        past = Window.partitionBy(*keys).orderBy(order, value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, FOLDS[how](value).over(past))
    return running_over(in_order(df, [*keys, order, value], parts), keys, order, value, out, how).drop("_part")
