"""Stores whose users expire whole: a user without an applied write for a time to live is forgotten, guards included.

An applied write, of any group, keeps all of a user's groups alive; a write refused for its guard does not. A user's
writes thus fall into lives, and a guard counts within its life only. Writes are taken in order of time, then of seq.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import PARTS, running_before
from tidemark.operators.store import _settled, _unbeaten, feature_columns
from tidemark.session import written_once


def _expired(last: str, now: str, ttl_seconds: int) -> Column:
    return F.col(last) + F.lit(ttl_seconds * 1_000_000) <= F.col(now)


def mark_lives(log: DataFrame, ttl_seconds: int, parts: int | None = PARTS) -> DataFrame:
    """Add ``life`` (the time of its first write) and ``accepted`` to the rows that have a guard and a time.

    Where any two writes of a user lie a time to live apart, a life ends for certain. What is left depends on itself:
    which writes are applied depends on where lives begin, and these on the writes applied. So guards are judged within
    the lives known so far; where that leaves a longer gap between applied writes, the first such gap of a life starts
    a new one, and only what follows it is judged again. A round is two running maxima (see ``running_before``) over the
    rows still open, and there are no more rounds than lives that hide in one stretch of writes. Runs jobs at once.
    """
    rows = log.where(F.col("guard").isNotNull() & F.col("write_ts").isNotNull()).withColumns(
        {"_at": F.struct("write_ts", "seq"), "_now": F.unix_micros("write_ts")}
    )
    rows = running_before(rows, ["user_id"], "_at", "_now", "_last", parts=parts)
    begins = F.when(F.col("_last").isNull() | _expired("_last", "_now", ttl_seconds), F.col("_now"))
    rows = running_before(rows.withColumn("_begins", begins), ["user_id"], "_at", "_begins", "_began", parts=parts)
    rows = rows.withColumn("_life", F.greatest("_begins", "_began")).drop("_last", "_begins", "_began")
    settled = []
    while True:
        judged = running_before(rows, ["user_id", "_life", "grp"], "_at", "guard", "_seen", parts=parts)
        judged = judged.withColumn("accepted", _unbeaten()).withColumn("_applied", F.when(F.col("accepted"), F.col("_now")))
        paced = running_before(judged.drop("_seen"), ["user_id", "_life"], "_at", "_applied", "_last", parts=parts)
        gaps = paced.where(_expired("_last", "_now", ttl_seconds)).groupBy(F.col("user_id").alias("_user"), F.col("_life").alias("_of"))
        broken = gaps.agg(F.min("_now").alias("_break"))
        same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_life") == F.col("_of"))
        round_ = written_once(paced.join(broken, same, "left").drop("_user", "_of", "_applied", "_last"), "lives")
        open_ = F.coalesce(F.col("_now") >= F.col("_break"), F.lit(False))
        settled.append(round_.where(~open_))
        rows = round_.where(open_).withColumn("_life", F.col("_break")).drop("_break", "accepted")
        if rows.isEmpty():
            break
    found = reduce(DataFrame.unionByName, settled)
    return found.select(*log.columns, F.timestamp_micros("_life").alias("life"), "accepted")


def fold_with_expiry(log: DataFrame, ttl_seconds: int, on_null: str = "keep", parts: int | None = PARTS) -> DataFrame:
    """What the store holds after all writes, as :func:`store.fold` has it, of each user's last life only.

    ``write_ts`` is the user's last applied write, which decides on expiry, for all groups. With it the result is itself
    a log: folded again with later rows it equals folding everything.
    """
    fields = feature_columns(log)
    accepted = written_once(mark_lives(log, ttl_seconds, parts).where("accepted"), "applied")
    ends = accepted.groupBy(F.col("user_id").alias("_user")).agg(F.max("life").alias("_lived"), F.max("write_ts").alias("_end"))
    own = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("life") == F.col("_lived"))
    last = accepted.join(ends, own).withColumn("write_ts", F.col("_end")).select(*log.columns)
    return _settled(last, fields, on_null)
